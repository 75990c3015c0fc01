"""Scores of quality and confidence, vectors, gates: column expressions and small joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is all zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.when(norm != 0, norm))


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has numbers only: no null, NaN or infinity; as doubles."""
    v = F.col(vector).cast("array<double>")
    return df.withColumn(vector, v).where((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def blocks(df: DataFrame, id_col: str, size: int) -> tuple[DataFrame, int]:
    """df with a block number (by a hash of the id), about `size` rows each, and the number of blocks."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")), n


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 1, at_least: float = -1.0, block: int = 1024, stored: int = 8192) -> DataFrame:
    """(query_id, vec_id, similarity): the k most alike vectors of each query, itself left out; ties by the smaller id.

    Blocks of queries meet blocks of vectors, neither side is sent to all executors, and of each meeting only k rows a query go
    on. Vectors with nulls, NaN or infinities take no part; one of all zeros has similarity 0.
    """
    asked, nq = blocks(usable(queries.select("vec_id", "embedding")), "vec_id", block)
    held, nv = blocks(usable(vectors.select("vec_id", "embedding")), "vec_id", stored)
    left = asked.withColumnsRenamed({"_b": "q", "vec_id": "query_id"}).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    right = held.withColumnRenamed("_b", "v").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": a["query_id"], "vec_id": b["vec_id"], "similarity": pd.Series(dtype="float64")}).head(0)
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        b = b.sort_values("vec_id")
        ids = b["vec_id"].to_numpy()
        alike = np.round(unit(np.array(a["embedding"].tolist())) @ unit(np.array(b["embedding"].tolist())).T, 6)
        out = []
        for own, row in zip(a["query_id"], alike, strict=True):
            may = np.nonzero((row >= at_least) & (ids != own))[0]
            best = may[np.argsort(-row[may], kind="stable")[:k]]
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[best], "similarity": row[best]}))
        return pd.concat(out)

    kinds = [df.schema["vec_id"].dataType.simpleString() for df in (queries, vectors)]
    rows = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInPandas(meet, f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return rows.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def quality(confidence: Column, form: Column, preserved: Column) -> Column:
    return 0.4 * confidence + 0.3 * form + 0.3 * preserved


def gate(confidence: Column, form: Column, preserved: Column) -> Column:
    """reject, warn or pass by the thresholds .7, .8 and .7."""
    return F.when((confidence < 0.7) | (preserved < 0.7), "reject").when(form < 0.8, "warn").otherwise("pass")


def confidence(known_terms: Column, form: Column, preserved: Column, agreement: Column) -> Column:
    """.5 and up to .15, .10, .10 and .15 for its four signals, from .1 to .98."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(0.5 + 0.15 * unit(known_terms) + 0.1 * unit(form) + 0.1 * unit(preserved) + 0.15 * unit(agreement), F.lit(0.1)), F.lit(0.98))


def review_needed(confidence_: Column, quality_: Column) -> Column:
    return F.when((confidence_ < 0.5) | (quality_ < 0.5), "high").when((confidence_ < 0.7) | (quality_ < 0.7), "medium").when(confidence_ < 0.8, "low")


def precision_recall(found: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """One row: precision, recall, f1 of found against gold, as sets."""
    a, b = found.select(*on).distinct().withColumn("_f", F.lit(1)), gold.select(*on).distinct().withColumn("_g", F.lit(1))
    n = a.join(b, on, "full_outer").agg(F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count("_f").alias("f"), F.count("_g").alias("g"))
    p, r = F.coalesce(F.col("tp") / F.when(F.col("f") > 0, F.col("f")), F.lit(0.0)), F.coalesce(F.col("tp") / F.when(F.col("g") > 0, F.col("g")), F.lit(0.0))
    return n.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(2 * p * r / F.when(p + r > 0, p + r), F.lit(0.0)), 6).alias("f1"))
