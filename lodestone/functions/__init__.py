"""Part of lodestone; see the README for what is where."""
