"""Examples for a prompt: by vectors, by keywords where no vector is near enough, and one of each category where nothing fits.

Vectors of inputs meet those of examples block by block (numpy inside a block), and so do keywords; of each block only the
best few of a category go on, so what is shuffled is bounded by blocks x categories x count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import blocks, usable
from lodestone.session import materialised

BOOST = 1.2


#: Inputs and examples of a block, and inputs that are scored at a time. Each block of inputs has the library shuffled once more.
ASKED, HELD, AT_ONCE = 16384, 8192, 512


def _top(score: np.ndarray, begins: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the `count` highest of each row and stretch of columns, the first of equals; -inf is none. Overwrites score."""
    row, found = np.arange(len(score)), []
    for i, j in zip(begins, [*begins[1:], score.shape[1]], strict=True):
        part = score[:, i:j]
        for _ in range(min(count, j - i)):
            at = part.argmax(1)
            has = part[row, at] > -np.inf
            if not has.any():
                break
            found.append((row[has], i + at[has]))
            part[row, at] = -np.inf
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (row[:0], row[:0])


def _in_order(examples: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Examples by category, then id, and where each category begins."""
    b = examples.sort_values(["category", "example_id"])
    return b, np.flatnonzero(np.diff(pd.factorize(b["category"])[0], prepend=-2))


def _met(inputs: DataFrame, library: DataFrame, score: Callable, count: int, column: str, kind: str) -> DataFrame:
    """(query_id, example_id, category, column): per query, category and block of examples the `count` best. score(inputs, examples) is a function
    of a slice of the inputs that gives a row for each of them, -inf where they do not meet."""
    asked, nq = blocks(inputs, "query_id", ASKED)
    held, ne = blocks(library, "example_id", HELD)
    left = asked.withColumnRenamed("_b", "q").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(ne - 1))))
    right = held.withColumnRenamed("_b", "e").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b, begins = _in_order(b)
            of = score(a, b)
            for at in range(0, len(a), AT_ONCE):
                rows = of(slice(at, at + AT_ONCE))
                i, j = _top(rows.copy(), begins, count)
                out.append(pd.DataFrame({"query_id": a["query_id"].to_numpy()[at + i], "example_id": b["example_id"].to_numpy()[j], "category": b["category"].to_numpy()[j], column: rows[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": a["query_id"], "example_id": b["example_id"], "category": b["category"], column: pd.Series(dtype="float64")}).head(0)

    kinds = {c: library.schema[c].dataType.simpleString() for c in ("example_id", "category")}
    met = left.groupBy("q", "e").cogroup(right.groupBy("q", "e")).applyInPandas(meet, f"query_id {inputs.schema['query_id'].dataType.simpleString()}, example_id {kinds['example_id']}, category {kinds['category']}, {column} double")
    return met.withColumn(column, F.col(column).cast(kind))


def _by_vectors(inputs: DataFrame, library: DataFrame, count: int, at_least: float, prefer: str | None) -> DataFrame:
    """(query_id, example_id, category, score, rank_score): per query the best `count` examples of each category, at_least alike."""

    def score(a: pd.DataFrame, b: pd.DataFrame) -> Callable:
        x, y = np.array(a["embedding"].tolist()), np.array(b["embedding"].tolist())
        length, other = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)

        def of(some: slice) -> np.ndarray:
            norms = length[some, None] * other[None]
            cosine = np.round(np.where(norms > 0, x[some] @ y.T / np.where(norms > 0, norms, 1), 0.0), 9)
            return np.where(cosine >= at_least, cosine, -np.inf)

        return of

    met = _met(usable(inputs.select("query_id", "embedding")), usable(library.select("example_id", "category", "embedding")), score, count, "score", "double")
    return met.withColumn("rank_score", _boosted(prefer))


def _by_keywords(inputs: DataFrame, library: DataFrame, count: int, prefer: str | None) -> DataFrame:
    """(query_id, example_id, category, score, rank_score): per query and block of examples the `count` of each category that have the most of its keywords, and any."""

    def score(a: pd.DataFrame, b: pd.DataFrame) -> Callable:
        flat = lambda rows: (np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([w for r in rows for w in r], object))
        asker, asked = flat(a["keywords"].tolist())
        holder, held = flat(b["keywords"].tolist())
        codes, words = pd.factorize(asked)  # null words are -1, as are words that nobody asks for
        code = pd.Index(words).get_indexer(held) if len(words) else np.full(len(held), -1)
        asker, codes = asker[codes >= 0], codes[codes >= 0]
        posted = np.unique(code[code >= 0] * len(b) + holder[code >= 0])
        ends = np.searchsorted(posted, np.arange(len(words) + 1) * len(b))
        has = posted % max(len(b), 1)
        of_asker = np.searchsorted(asker, np.arange(len(a) + 1))

        def of(some: slice) -> np.ndarray:
            out = np.zeros((len(range(*some.indices(len(a)))), len(b)))
            for i, q in enumerate(range(*some.indices(len(a)))):
                lists = [has[ends[c] : ends[c + 1]] for c in codes[of_asker[q] : of_asker[q + 1]]]
                if lists:
                    out[i] = np.bincount(np.concatenate(lists), minlength=len(b))
            return np.where(out > 0, out, -np.inf)

        return of

    own = library.select("example_id", "category", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    met = _met(inputs, own, score, count, "n", "long")
    hits = met.join(inputs.select("query_id", F.size("keywords").alias("all")), "query_id").select("query_id", "example_id", "category", F.round(F.col("n") / F.col("all"), 9).alias("score"))
    return hits.withColumn("rank_score", _boosted(prefer))


def _boosted(prefer: str | None) -> Column:
    return F.col("score") if prefer is None else F.when(F.col("category") == prefer, F.round(F.col("score") * BOOST, 9)).otherwise(F.col("score"))


def _best(scored: DataFrame, count: int, diverse: bool) -> DataFrame:
    """(query_id, place, example_id) of (query_id, example_id, category, rank_score): at most half (rounded up) of a category first, then the rest."""
    order = [F.desc("rank_score"), F.col("example_id")]
    own = scored.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "category").orderBy(*order))).where(F.col("_i") <= count)
    late = (F.col("_i") > -(-count // 2)).cast("int") if diverse else F.lit(0)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(late, *order))).where(F.col("place") <= count).select("query_id", "place", "example_id")


def select_examples(inputs: DataFrame, library: DataFrame, count: int = 3, category: str | None = None, diverse: bool = True, at_least: float = 0.3, prefer: str | None = None) -> DataFrame:
    """(query_id, way, place, example_id): up to `count` examples for each input.

    inputs has (query_id, embedding, keywords), library (example_id, category, embedding, keywords), ids without repeats. Only
    examples of `category` take part; if there is none, all do. way is `vectors` where an example is at_least alike by cosine;
    else `keywords`: the share of the input's keywords (repeats count) that the example has, examples without any filling up by id;
    else `default`, where nothing is shared: one of each category in turn, categories and their examples by id. A preferred category counts 1.2-fold in the order only.
    Null vectors, and those with nulls, NaN or infinities, are alike to none; null keywords are none. An empty library gives no rows.
    """
    if category is not None:
        any_of = F.broadcast(library.agg(F.coalesce(F.max(F.coalesce(F.col("category") == category, F.lit(False))), F.lit(False)).alias("_any")))
        library = library.join(any_of).where(~F.col("_any") | F.coalesce(F.col("category") == category, F.lit(False))).drop("_any")
    near = materialised(_by_vectors(inputs, library, count, at_least, prefer))
    first = _best(near, count, diverse)
    rest = materialised(inputs.select("query_id", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")).join(near.select("query_id").distinct(), "query_id", "left_anti"))
    hits = materialised(_by_keywords(rest, library, count, prefer))

    # Of examples that share nothing only the first few can be chosen: `count` of each of the 2 * count categories that begin first.
    own = Window.partitionBy("category").orderBy("example_id")
    heads = library.select("example_id", "category").withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= count).withColumn("_f", F.min("example_id").over(Window.partitionBy("category")))
    begin = heads.groupBy("category").agg(F.min("_f").alias("f")).orderBy("f").limit(2 * count).withColumn("_c", F.row_number().over(Window.orderBy("f")) - 1)
    heads = heads.alias("h").join(F.broadcast(begin.alias("b")), F.col("h.category").eqNullSafe(F.col("b.category"))).select("example_id", "h.category", "_k", "_c")
    some = hits.select("query_id").distinct()
    free = some.join(F.broadcast(heads.select("example_id", "category"))).join(hits.select("query_id", "example_id"), ["query_id", "example_id"], "left_anti").withColumns({"score": F.lit(0.0), "rank_score": F.lit(0.0)})
    second = _best(hits.unionByName(free), count, diverse)

    # In turn: place i goes to category i modulo their number; a category that has no example left gives none.
    n = begin.agg(F.count(F.lit(1)).alias("_n"))
    turn = F.col("_c") + (F.col("_k") - 1) * F.col("_n")
    turns = heads.join(F.broadcast(n)).where(turn < count).select("example_id", F.row_number().over(Window.orderBy(turn)).alias("place"))
    third = rest.select("query_id").join(some, "query_id", "left_anti").join(F.broadcast(turns)).select("query_id", "place", "example_id")
    way = lambda df, name: df.select("query_id", F.lit(name).alias("way"), "place", "example_id")
    return way(first, "vectors").unionByName(way(second, "keywords")).unionByName(way(third, "default"))
