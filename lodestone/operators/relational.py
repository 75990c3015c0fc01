"""Joins, set operations, upserts and consistency checks between two copies of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import partitions, spread


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no edge: the endpoints of both sides are one table of keys, so that an anti join on equality does."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def orphaned_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reason) of edges whose subject, object or both are no nodes.

    Edges and ids meet sorted, in partitions of a bounded size: a hash of all ids would grow with them in every task.
    """
    ids, n = nodes.select("id").withColumn("there", F.lit(True)), partitions(edges)
    out = spread(edges.select(F.col("id").alias("edge"), "src", "dst"), "src", n=n).join(ids.select(F.col("id").alias("src"), F.col("there").alias("s")).hint("merge"), "src", "left").select("edge", "dst", "s")
    out = spread(out, "dst", n=n).join(ids.select(F.col("id").alias("dst"), F.col("there").alias("d")).hint("merge"), "dst", "left")
    reason = F.when(F.col("s").isNull() & F.col("d").isNull(), "both").when(F.col("s").isNull(), "subject").when(F.col("d").isNull(), "object")
    return out.select(F.col("edge").alias("id"), reason.alias("reason")).where("reason is not null")


def id_diff(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(key, side): keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer").where("_l is null or _r is null")
    return both.select(key, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side"))


def property_mismatches(left: DataFrame, right: DataFrame, fields: list[str], key: str = "id", tolerance: float = 0.01) -> DataFrame:
    """(key, field, left, right): fields that differ between rows of the same key; numbers may differ by the tolerance."""
    kinds = dict(left.dtypes)
    both = left.select(key, *[F.col(f).alias(f"l_{f}") for f in fields]).join(right.select(key, *[F.col(f).alias(f"r_{f}") for f in fields]), key)

    def differs(f: str) -> Column:
        a, b = F.col(f"l_{f}"), F.col(f"r_{f}")
        same = F.abs(a - b) <= tolerance if kinds[f] in ("double", "float") else a == b
        return ~F.coalesce(same, a.isNull() & b.isNull())

    found = F.array_compact(F.array(*[F.when(differs(f), F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").cast("string").alias("left"), F.col(f"r_{f}").cast("string").alias("right"))) for f in fields]))
    return both.select(key, F.explode(found).alias("m")).select(key, "m.*")


def upsert(base: DataFrame, changes: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """base with changes put in by key; of several changes of a key the last by order counts. Columns as in base."""
    if order is not None:
        changes = changes.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).where("_i = 1")
    changes = changes.select(*base.columns)
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes)


def delete(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys, on, "left_anti")


def detach_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ids (id), and edges without those that touch them."""
    kept = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept.select(*edges.columns)


def patch(base: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with fields replaced where a patch of the key has a value."""
    given = patches.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    out = base.join(given, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def changed_since(df: DataFrame, since: str, column: str = "updated_at") -> DataFrame:
    """Rows changed after a point in time: an incremental sync reads these only."""
    return df.where(F.col(column) > F.lit(since).cast("timestamp"))


def keep_best(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """One row for each key, that of the highest score (then of the smallest row)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), *[F.col(c) for c in rest if c != score])).alias("_b"))
    return best.select(*keys, "_b.*")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets give 0."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.when(union > 0, union), F.lit(0.0))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
