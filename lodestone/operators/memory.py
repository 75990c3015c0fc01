"""A memory of vectors: for each query the most alike stored vector, if it is alike enough.

Both sides are tables of any size, cut into blocks of a bounded number of vectors. Unit vectors of cosine t or more lie within
r = sqrt(2 - 2t) of each other. Stored vectors chosen by a hash, PIVOTS at most, cut the space into cells; a block holds
vectors of one nearest pivot. A block of queries meets a block of stored vectors only if for each pivot the distances that
occur in both come within r (the triangle inequality rules out all others); there matrices decide, and one row a query goes
on. A pair of blocks is one task at most; neither side is sent to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scoring import dot
from lodestone.session import materialised

PIVOTS, SLACK = 64, 1e-6
#: Vectors in a block of queries and of stored ones, and in the pieces that are multiplied at once.
ASKED, STORED, PIECE = 16_384, 32_768, (1024, 4096)


def _unit(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, u): unit vectors; null and zero vectors, and those with null or odd numbers, are left out."""
    v = F.col(vector_col).cast("array<double>")
    kept = vectors.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select(F.col(id_col).alias("id"), v.alias("v"))
    scaled = kept.withColumn("n", F.sqrt(dot(F.col("v"), F.col("v")))).where("n > 0")
    return scaled.select("id", F.transform("v", lambda x: x / F.col("n")).alias("u"))


def _rows(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    u = b.column("u")
    u = u.combine_chunks() if isinstance(u, pa.ChunkedArray) else u
    return u.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _cells(units: DataFrame, pivots: np.ndarray) -> DataFrame:
    """units (id, u) with their row, nearest pivot (cell) and distances from all pivots (d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = np.sqrt(np.maximum(2 - 2 * _rows(b) @ pivots.T, 0.0))
            ends = pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], names=[*b.schema.names, "cell", "d"])

    return units.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"id {units.schema['id'].dataType.simpleString()}, u array<double>, row long, cell int, d array<double>")


def _blocks(cells: DataFrame, name: str, size: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """cells with the block (name) of about size rows that each is in, and (name, near, far): each block's range of distances from each pivot."""
    cells = materialised(cells)
    many = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("n"))
    held = cells.join(F.broadcast(many), "cell").withColumn(name, F.concat_ws("-", "cell", F.pmod(F.xxhash64("row"), F.col("n"))))  # a row for each pivot is broadcast
    at = range(1, pivots + 1)
    ranges = held.groupBy(name).agg(F.array(*[F.min(F.element_at("d", i)) for i in at]).alias(f"{name}_near"), F.array(*[F.max(F.element_at("d", i)) for i in at]).alias(f"{name}_far"))
    return held.select("id", "row", "u", name), ranges


def best_matches(queries: DataFrame, memory: DataFrame, at_least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, asked_block: int = ASKED, stored_block: int = STORED) -> DataFrame:
    """(query_id, vec_id, similarity): for each query the stored vector of the highest cosine, where it is at_least; of equals (to
    9 digits) the smallest id. Queries that nothing is like have no row.

    Vectors that are null, all zero, or hold nulls, NaN or infinities match nothing; all others have one length. There are
    no more cells than blocks of stored vectors.
    """
    if not 0 < at_least <= 1:
        raise ValueError("the least cosine is over 0 and at most 1")
    r = float(np.sqrt(max(2 - 2 * at_least, 0.0))) + 1e-4  # and what rounding to 9 digits lifts
    stored = materialised(_unit(memory, id_col, vector_col))
    n = stored.count()
    kinds = [df.schema[id_col].dataType.simpleString() for df in (queries, memory)]
    if not n:
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")
    k = min(pivots, -(-n // stored_block))
    centres = np.array([x["u"] for x in stored.orderBy(F.xxhash64("id"), "id").limit(k).collect()], np.float64)
    k = len(centres)
    held, near_held = _blocks(_cells(stored, centres), "s", stored_block, k)
    asked, near_asked = _blocks(_cells(_unit(queries, id_col, vector_col), centres), "q", asked_block, k)
    apart = F.exists(F.arrays_zip("q_near", "q_far", "s_near", "s_far"), lambda x: (x["s_near"] - x["q_far"] > r + SLACK) | (x["q_near"] - x["s_far"] > r + SLACK))
    meets = materialised(near_asked.crossJoin(near_held).where(~apart).select("q", "s"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")
        x, y, ids = (_rows(a), _rows(b), b.column("id")) if a.num_rows and b.num_rows else (np.empty((0, 1)), np.empty((0, 1)), b.column("id"))
        best, which = np.full(len(x), -2.0), np.zeros(len(x), np.int64)
        for i in range(0, len(x), PIECE[0]):
            for j in range(0, len(y), PIECE[1]):
                s = x[i : i + PIECE[0]] @ y[j : j + PIECE[1]].T
                may = np.nonzero(s.max(axis=1) >= at_least - 1e-8)[0]
                s = np.round(s[may], 9)
                first = s.argmax(axis=1)  # ids go up, so of equals the smallest
                top, at = s[np.arange(len(may)), first], may + i
                better = top > best[at]
                best[at[better]], which[at[better]] = top[better], first[better] + j
        found = np.nonzero(best >= at_least)[0]
        return pa.table([a.column("row").take(found), a.column("id").take(found), ids.take(which[found]), pa.array(best[found])], names=["row", "query_id", "vec_id", "similarity"])

    left, right = asked.join(meets, "q"), held.join(meets, "s")
    met = left.groupBy("q", "s").cogroup(right.groupBy("q", "s")).applyInArrow(meet, f"row long, query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")
    best = met.groupBy("row", "query_id").agg(F.min_by(F.struct("vec_id", "similarity"), F.struct(-F.col("similarity"), F.col("vec_id"))).alias("b"))
    return best.select("query_id", "b.vec_id", F.round("b.similarity", 6).alias("similarity"))


def hit_rates(queries: DataFrame, memory: DataFrame, found: DataFrame) -> DataFrame:
    """One row (asked, hits, misses, hit_rate, entries): the rate is 0 where nothing was asked."""
    n = queries.agg(F.count(F.lit(1)).alias("asked")).join(found.agg(F.count(F.lit(1)).alias("hits"))).join(memory.agg(F.count(F.lit(1)).alias("entries")))
    return n.select("asked", "hits", (F.col("asked") - F.col("hits")).alias("misses"), F.round(F.coalesce(F.col("hits") / F.when(F.col("asked") > 0, F.col("asked")), F.lit(0.0)), 6).alias("hit_rate"), "entries")
