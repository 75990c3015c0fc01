"""Corrections, learned terms, consensus, batches, pools, caches: what a translation workflow keeps count of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_status(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, done, failed, progress, status): completed, failed or partial once nothing is open; else processing."""
    by = jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "approved").alias("done"), F.count_if(F.col("status") == "rejected").alias("failed"))
    over = F.col("done") + F.col("failed")
    status = F.when(over < F.col("total"), "processing").when(F.col("failed") == 0, "completed").when(F.col("done") == 0, "failed").otherwise("partial")
    return by.select(*keys, "total", "done", "failed", F.round(100.0 * over / F.col("total"), 2).alias("progress"), status.alias("status"))


def suggested_terms(pairs: DataFrame, dictionary: DataFrame, at_least: int = 2) -> DataFrame:
    """(term, english, n, consistency, level): terms seen often enough that the dictionary does not have, with their commonest translation."""
    by = pairs.groupBy("term", "target").agg(F.count(F.lit(1)).alias("n"))
    out = by.groupBy("term").agg(F.min_by("target", F.struct(-F.col("n"), F.col("target"))).alias("english"), F.sum("n").alias("n"), F.max("n").alias("top")).where(F.col("n") >= at_least)
    share = F.col("top") / F.col("n")
    level = F.when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low")
    return out.join(dictionary.select("term"), "term", "left_anti").select("term", "english", "n", F.round(share, 6).alias("consistency"), level.alias("level"))


def learned_terms(known: DataFrame, seen: DataFrame) -> DataFrame:
    """known (term, n, confidence, last) with what was seen added: counts summed, confidence and last at their highest."""
    return known.unionByName(seen).groupBy("term").agg(F.sum("n").alias("n"), F.round(F.max("confidence"), 6).alias("confidence"), F.max("last").alias("last"))


def consensus(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, answer, votes, confidence): the answer of the largest summed weight; weight = confidence * (.7 + .3 * share of equal answers).

    The chosen answer's mean confidence is lifted by .15, .10 or .05 for a share of all, two thirds or half of the answers.
    """
    by = answers.groupBy(*keys, "answer").agg(F.count(F.lit(1)).alias("votes"), F.avg("confidence").alias("mean"), F.sum("confidence").alias("sum"))
    total = by.groupBy(*keys).agg(F.sum("votes").alias("all"))
    weighed = by.join(total, keys).withColumn("share", F.col("votes") / F.col("all")).withColumn("weight", F.round(F.col("sum") * (0.7 + 0.3 * F.col("share")), 9))
    best = weighed.groupBy(*keys).agg(F.min_by(F.struct("answer", "votes", "mean", "share"), F.struct(-F.col("weight"), F.col("answer"))).alias("b"))
    lift = F.when(F.col("b.share") >= 1, 0.15).when(F.col("b.share") >= 2 / 3, 0.1).when(F.col("b.share") >= 0.5, 0.05).otherwise(0.0)
    return best.select(*keys, "b.answer", "b.votes", F.round(F.least(F.lit(1.0), F.col("b.mean") + lift), 6).alias("confidence"))


def joined_chunks(chunks: DataFrame, keys: list[str], order: str, text: str, score: str) -> DataFrame:
    """(keys, text, confidence): pieces in order, and their mean score."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "\n").alias("text"), F.round(F.avg(score), 6).alias("confidence"))


def pool_status(calls: DataFrame, key: str) -> DataFrame:
    """(key, calls, errors, mean_ms, state): a key with more than a quarter of errors is limited."""
    by = calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.count("error_type").alias("errors"), F.round(F.avg("ms"), 4).alias("mean_ms"))
    return by.withColumn("state", F.when(F.col("errors") > F.col("calls") * 0.25, "limited").otherwise("available"))


def hit_rates(lookups: DataFrame, key: str, hit: Column) -> DataFrame:
    return lookups.groupBy(key).agg(F.count(F.lit(1)).alias("lookups"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("rate"))


def regression_score(runs: DataFrame) -> DataFrame:
    """One row: pass rate, means and the score 100 * (.5 pass + .3 similarity + .2 confidence) with its verdict."""
    r = runs.agg(F.avg(F.col("passed").cast("int")).alias("p"), F.avg("similarity").alias("s"), F.avg("confidence").alias("c"))
    score = 100 * (0.5 * F.col("p") + 0.3 * F.col("s") + 0.2 * F.col("c"))
    return r.select(F.round(score, 4).alias("score"), F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").otherwise("poor").alias("verdict"))


def compared_versions(runs: DataFrame, old: str, new: str, least: float = 0.05) -> DataFrame:
    """One row for runs (example, version, similarity) of two versions: examples of both, improved, regressed, unchanged, mean change.

    Of several runs of an example the mean counts; a change under least is none. Examples of one version only are left out.
    """
    of = lambda v: F.avg(F.when(F.col("version") == v, F.col("similarity")))
    by = runs.groupBy("example").agg(of(old).alias("a"), of(new).alias("b")).where("a is not null and b is not null")
    change = F.col("b") - F.col("a")
    counted = [F.count_if(c).alias(k) for k, c in (("improved", change >= least), ("regressed", change <= -least), ("unchanged", F.abs(change) < least))]
    return by.agg(F.count(F.lit(1)).alias("examples"), *counted, F.round(F.avg(change), 6).alias("mean_change"))


def lane_class(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def query_key(kind: Column, **params: Column) -> Column:
    """A cache key: the kind of query and the MD5 of its parameters as JSON in the order of their names, nulls included."""
    named = F.struct(*[c.alias(k) for k, c in sorted(params.items())])
    return F.concat(kind, F.lit(":"), F.md5(F.to_json(named, {"ignoreNullFields": "false"})))


def swim_lane(birth: Column, founded: Column, occurred: Column, death: Column, default: int = 1200) -> tuple[Column, Column]:
    """Start and end year of a bar on a timeline."""
    start = F.coalesce(birth, founded, occurred, F.lit(default))
    return start, F.coalesce(death, start)


#: Words that point to a predicate.
HINTS = {"teacher_of": r"\b(taught|teacher|guru)\b", "student_of": r"\b(studied|disciple|student)\b", "wrote": r"\b(wrote|composed|author)\b", "lived_at": r"\b(lived|resided|dwelt)\b", "founded": r"\b(founded|established|built)\b"}


def hinted_predicates(text: Column) -> Column:
    """Array of the predicates that words of the text point to."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(t.rlike(p), k) for k, p in HINTS.items()]))
