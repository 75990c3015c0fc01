"""How well found entities and their confidences fit what was expected, by case, difficulty and type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "?"  # the key of expected entities without a name; plain names hold no such character


def plain_name(name: Column) -> Column:
    """Lower case, only letters a-z, digits, underscores and blanks, runs of blanks as one."""
    return F.regexp_replace(F.regexp_replace(F.btrim(F.lower(name), F.lit(" \t\n\x0b\f\r")), r"[^a-z0-9_\s]", ""), r"\s+", " ")


def case_scores(cases: DataFrame, expected: DataFrame, found: DataFrame, sure: float = 0.8, passing: float = 0.7, unnamed: str = "UNKNOWN") -> DataFrame:
    """(case_id, difficulty, precision, recall, f1, confidence_accuracy, passed) of every case.

    cases has (case_id, difficulty), expected (case_id, type, name), found (case_id, found_id, type, names, confidence). An expected
    entity is met by a found one of its case and type that has its plain name, or by any of that type where its name is `unnamed`.
    precision is the number of expected entities met over that of found ones (so it can be over 1 where entities are expected
    twice), recall over that of expected ones; confidence_accuracy is the share of found entities surer than `sure` that meet an
    expected one, 1 without such. With nothing expected and nothing found all are 1; with nothing found 0. Both sides meet by one
    key, so a hot name is one key of one case.
    """
    keys = F.array_distinct(F.concat(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x: plain_name(F.coalesce(x, F.lit("")))), F.array(F.lit(ANY))))
    sought = expected.select("case_id", "type", F.when(F.col("name") == unnamed, ANY).otherwise(plain_name(F.coalesce("name", F.lit("")))).alias("key"))
    named = found.select("case_id", "found_id", "type", "confidence", F.explode(keys).alias("key"))
    on = ["case_id", "type", "key"]
    met = sought.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).join(named.select(*on).distinct(), on, "left_semi").groupBy("case_id").agg(F.sum("n").alias("met"))
    right = named.where(F.col("confidence") > sure).join(sought.select(*on).distinct(), on, "left_semi").groupBy("case_id").agg(F.count_distinct("found_id").alias("right"))
    n_found = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("confidence") > sure).alias("sure"))
    n_expected = expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("expected"))
    figures = ("expected", "found", "sure", "met", "right")
    sums = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [n_expected, n_found, met, right]).groupBy("case_id").agg(*[F.sum(c).alias(c) for c in figures])
    all_ = cases.select("case_id", "difficulty").join(sums, "case_id", "left").fillna(0, list(figures))
    empty = (F.col("expected") == 0) & (F.col("found") == 0)
    share = lambda a, b: F.when(empty, 1.0).otherwise(F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0)))
    scored = all_.select("case_id", "difficulty", share("met", "found").alias("precision"), share("met", "expected").alias("recall"), F.when(empty, 1.0).when(F.col("found") == 0, 0.0).when(F.col("sure") == 0, 1.0).otherwise(F.col("right") / F.when(F.col("sure") > 0, F.col("sure"))).alias("confidence_accuracy"))
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.coalesce(2 * p * r / F.when(p + r > 0, p + r), F.lit(0.0))).withColumn("passed", F.col("f1") >= passing)


def calibration(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """(scope, value, cases, passed, failed, pass_rate, precision, recall, f1, confidence_accuracy): means over cases (each case
    counts once) of all cases, of each difficulty, and of the cases in which a type is expected."""
    kinds = scores.join(expected.select("case_id", "type").distinct(), "case_id")
    scopes = [scores.withColumns({"scope": F.lit("all"), "value": F.lit("all")}), scores.withColumns({"scope": F.lit("difficulty"), "value": F.col("difficulty")}), kinds.withColumns({"scope": F.lit("type"), "value": F.col("type")})]
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    out = None
    for s in scopes:
        by = s.groupBy("scope", "value").agg(
            F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"),
            *[mean(c) for c in ("precision", "recall", "f1", "confidence_accuracy")],
        )
        out = by if out is None else out.unionByName(by)
    return out
