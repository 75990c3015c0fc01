"""Exact search for the k highest inner products, as a Voronoi join of queries and data.

1. Components become whole numbers, floor(scale * x). A vector x gets one more coordinate, sqrt(M*M - x.x) with M the
   greatest norm, a query gets 0 there: then the nearest vectors of a query are those of the highest inner product.
2. PIVOTS vectors, chosen by a hash, cut the space; each query and each vector belongs to its nearest pivot.
3. Summaries: of each group of vectors a histogram of distances to the pivot, of each group of queries the number and the
   greatest distance. They alone give, for each group of queries, a distance within which each of its queries must have
   k others, and from that, for each pair of groups, the distances from the pivot that vectors may have to matter.
4. Neighbouring small groups of queries are put together into sets, groups over SET_QUERIES queries are dealt over several.
   Each vector goes to the sets that its distance allows, and there into one of the blocks of about BLOCK vectors.
5. A block meets the queries of its set by matrix products and keeps each query's k best; the best k of these are the result.

Pivots, histograms and bounds are of a size that PIVOTS alone bounds; only they come to the driver. Bounds are widened by
SLACK against rounding. Scores are exact: products run in doubles only where all sums stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import saved

#: Pivots at most, and distance steps of a histogram.
PIVOTS, STEPS = 64, 256
SET_QUERIES, BLOCK = 512, 2048
SLACK = 1e-6
#: Queries whose products with a block are held at once.
_ROWS = 128
_LONG = 1 << 63


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as longs; rows without id or vector, or with a null or non-finite component, are left out.

    Rows that share an id are one: the greatest of their vectors, in the order of arrays, counts.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & real)
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v")).groupBy("id").agg(F.max("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64) if n else np.zeros((0, 0), np.int64)


def _lifted(v: np.ndarray, top: float, query: bool) -> np.ndarray:
    x = v.astype(np.float64)
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))
    return np.concatenate((x, rest[:, None]), axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _assigned(vectors: DataFrame, pivots: np.ndarray, top: float, step: float, is_query: Column) -> DataFrame:
    """(id, v, query, g, d, step): the nearest pivot, the distance from it and its step; queries come once more, as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, query = _matrix(b.column("v")), b.column("query").to_numpy(zero_copy_only=False)
            for as_query, at in ((False, np.arange(len(v))), (True, np.flatnonzero(query))):
                if not len(at):
                    continue
                d = _distances(_lifted(v[at], top, as_query), pivots)
                g = d.argmin(axis=1)
                d = d[np.arange(len(at)), g]
                rows = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("v"), pa.array(np.full(len(at), as_query)), pa.array(g.astype(np.int32)), pa.array(d), pa.array(np.minimum(d / step, STEPS - 1).astype(np.int32))],
                    names=["id", "v", "query", "g", "d", "step"],
                )

    return vectors.select("id", "v", is_query.alias("query")).mapInArrow(run, "id long, v array<long>, query boolean, g int, d double, step int")


def group_bounds(between: np.ndarray, reach: np.ndarray, count: np.ndarray, step: float, k: int) -> np.ndarray:
    """For each group of queries a distance within which each of its queries has k vectors at least (infinite if there are fewer).

    between: distances of the pivots; reach: greatest distance of each group's queries from its pivot; count[j, s]: vectors
    of group j whose distance from its pivot is in step s.
    """
    edges = np.arange(1, count.shape[1] + 1) * step
    out = np.full(len(reach), np.inf)
    for i in range(len(reach)):
        most = (between[i][:, None] + edges[None]).ravel()
        order = np.argsort(most, kind="stable")
        enough = np.searchsorted(np.cumsum(count.ravel()[order]), k)
        if enough < len(order):
            out[i] = most[order[enough]] + reach[i]
    return out


def query_sets(between: np.ndarray, queries: np.ndarray) -> list[tuple[list[int], int]]:
    """Sets of groups with at most SET_QUERIES queries together, near ones first, and the parts that a larger group is dealt over."""
    left, sets = set(np.flatnonzero(queries).tolist()), []
    at = min(left, default=None)
    now: list[int] = []
    while at is not None:
        left.discard(at)
        if now and queries[now].sum() + queries[at] > SET_QUERIES:
            sets.append((now, 1))
            now = []
        if queries[at] > SET_QUERIES:
            sets.append(([at], int(-(-queries[at] // SET_QUERIES))))
        else:
            now.append(at)
        at = min(left, key=lambda j, i=at: (between[i, j], j), default=None)
    return [*sets, (now, 1)] if now else sets


def _best(queries: np.ndarray, query_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, scores) of each query's k best in one block; ties to the smaller id."""
    order = np.argsort(ids)
    v, ids = v[order], ids[order]
    low, high = (max(abs(int(x.min())), abs(int(x.max()))) for x in (queries, v))
    bound = low * high * v.shape[1]
    if bound >= _LONG:
        queries, v = queries.astype(object), v.astype(object)
    elif bound < 1 << 53:
        queries, v = queries.astype(np.float64), v.astype(np.float64)
    for at in range(0, len(queries), _ROWS):
        score = queries[at : at + _ROWS] @ v.T
        score = score.astype(np.int64) if score.dtype != object else score
        who = query_ids[at : at + _ROWS]
        if score.dtype != object and bound * len(ids) < 1 << 62:
            packed = score * len(ids) + np.arange(len(ids) - 1, -1, -1)  # one number holds the score, then the place
            packed[who[:, None] == ids[None]] = -_LONG
            few = min(k, len(ids))
            top = np.argpartition(packed, len(ids) - few, axis=1)[:, len(ids) - few :]
            keep = np.take_along_axis(packed, top, axis=1) != -_LONG
            row = np.repeat(np.arange(len(who)), few).reshape(keep.shape)
            yield who[row[keep]], ids[top[keep]], score[row[keep], top[keep]]
            continue
        for r in range(len(who)):
            other = np.flatnonzero(ids != who[r])
            top = np.array(sorted(other.tolist(), key=lambda c, s=score[r]: (-s[c], c))[:k], np.int64)
            yield np.full(len(top), who[r]), ids[top], np.array([_long(x) for x in score[r][top]], np.int64)


def _long(x: int) -> int:
    if not -_LONG <= x < _LONG:
        raise OverflowError(f"the score {x} is no long")
    return int(x)


def top_products(rows: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every its k highest scores among all other rows.

    The score is the inner product of floor(scale * x); ties go to the smaller id; a query with fewer partners has all.
    Rows with a null id or vector, or with a null, NaN or infinite component, take no part; rows that share an id are one
    (see whole_vectors). Vectors of different lengths do not meet; those of length 0 take no part. A score that no long
    holds is an error. An empty table gives no rows.
    """
    vectors = saved(whole_vectors(rows, id_col, vector_col, scale).where("size(v) > 0"))
    found = None
    for (size,) in vectors.select(F.size("v")).distinct().sort(F.size("v")).collect():  # lengths of vectors; usually one
        of = _top_of_length(vectors.where(F.size("v") == size), k, every, pivots)
        found = of if found is None else found.unionByName(of)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top_of_length(vectors: DataFrame, k: int, every: int, most_pivots: int) -> DataFrame:
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    top = vectors.agg(F.max(square)).first()[0] * (1 + SLACK)
    chosen = vectors.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(most_pivots).toPandas()
    centres = _lifted(np.array(chosen["v"].tolist(), np.int64), top, False)
    between, step = _distances(centres, centres), 2 * np.sqrt(max(top, 1.0)) / (STEPS - 1)
    dealt = saved(_assigned(vectors, centres, top, step, F.col("id") % every == 0))

    n, slack = len(centres), SLACK * np.sqrt(max(top, 1.0)) * 10
    count, queries, reach = np.zeros((n, STEPS), np.int64), np.zeros(n, np.int64), np.zeros(n)
    for r in dealt.groupBy("query", "g", "step").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect():
        if r["query"]:
            queries[r["g"]] += r["n"]
            reach[r["g"]] = max(reach[r["g"]], r["far"])
        else:
            count[r["g"], r["step"]] += r["n"]
    # One more than k, as the query itself is among the vectors.
    near = group_bounds(between, reach, count, step, k + 1) + slack
    low, high = between - (reach + near)[:, None] - slack, between + (reach + near)[:, None] + slack

    places, homes = [], []
    for number, (groups, parts) in enumerate(query_sets(between, queries)):
        lo, hi = low[groups].min(axis=0), high[groups].max(axis=0)
        edges = np.arange(STEPS) * step
        some = int(count[(edges[None] + step >= lo[:, None]) & (edges[None] <= hi[:, None])].sum())
        blocks = max(1, -(-some // BLOCK))
        places += [(j, number, parts, blocks, float(lo[j]), float(hi[j])) for j in range(n)]
        homes += [(g, number, parts, blocks) for g in groups]
    # At most pivots * pivots rows.
    where = spark.createDataFrame(places, "g int, set int, parts int, blocks int, low double, high double").groupBy("g").agg(F.collect_list(F.struct("set", "parts", "blocks", "low", "high")).alias("sets"))
    home = spark.createDataFrame(homes, "g int, set int, parts int, blocks int")
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    mine = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")

    of_vectors = dealt.where("not query").join(F.broadcast(where), "g")
    of_vectors = of_vectors.select("id", "v", F.explode(F.filter("sets", lambda s: (F.col("d") >= s["low"]) & (F.col("d") <= s["high"]))).alias("s"))
    of_vectors = of_vectors.select("id", "v", F.lit(False).alias("query"), F.col("s.set").alias("set"), mine(F.col("s.blocks"), 1).alias("block"), F.explode(spread(F.col("s.parts"))).alias("part"))
    of_queries = dealt.where("query").join(F.broadcast(home), "g")
    of_queries = of_queries.select("id", "v", F.lit(True).alias("query"), "set", mine(F.col("parts"), 2).alias("part"), F.explode(spread(F.col("blocks"))).alias("block"))

    def solve(block: pa.Table) -> pa.Table:
        query = block["query"].to_numpy()
        ids, v = block["id"].to_numpy(), _matrix(block["v"])
        found = list(_best(v[query], ids[query], v[~query], ids[~query], k)) if query.any() and not query.all() else []
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns), strict=True)))

    return of_vectors.unionByName(of_queries).groupBy("set", "part", "block").applyInArrow(solve, "query_id long, vec_id long, score long")
