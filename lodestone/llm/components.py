"""Connected components of a link table by contraction; all of it stays in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved
from lodestone.session import dropped


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for each id of links (a, b) that reaches a smaller one. All other ids are their own root.

    Each round every node points to its smallest neighbour (or itself), chains of pointers are shortened to their ends,
    and links are carried over to these ends; at least half of the nodes that have a link are gone after a round.
    Links whose ends are the same, repeated links and empty tables are fine; a null end is no link.
    """
    edges = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    roots: DataFrame | None = None
    while not edges.isEmpty():
        pointer = saved(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")))
        while True:  # pointers to pointers; only ids that have a smaller neighbour are in the table
            up = pointer.select(F.col("id").alias("to"), F.col("to").alias("next"))
            new = saved(pointer.join(up, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            dropped(pointer)
            pointer, moved = new, not new.where("moved").isEmpty()
            if not moved:
                break
        of_a = pointer.select(F.col("id").alias("a"), F.col("to").alias("new_a"))
        of_b = pointer.select(F.col("id").alias("b"), F.col("to").alias("new_b"))
        carried = edges.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("new_a", "a").alias("x"), F.coalesce("new_b", "b").alias("y")).where("x <> y")
        fewer = saved(carried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        # Ids that pointed to nodes which now point on follow them; nodes that point for the first time join them.
        now = pointer.select("id", F.col("to").alias("root"))
        if roots is not None:
            led = roots.join(now.select(F.col("id").alias("root"), F.col("root").alias("new_root")), "root", "left").select("id", F.coalesce("new_root", "root").alias("root"))
            now = led.unionByName(now)
        new_roots = saved(now)
        dropped(edges, pointer, roots)
        edges, roots = fewer, new_roots
    return roots if roots is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
