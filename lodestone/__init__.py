"""Lodestone: corpus and knowledge-graph analytics as Spark DataFrame jobs."""
