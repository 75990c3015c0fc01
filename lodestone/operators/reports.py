"""Reports over corrections, terms, jobs, metrics and syncs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, keys: list[str], order: list, columns: list[str], n: int = 5) -> DataFrame:
    """(keys, n, examples): the number of rows of each group, and its first n rows by order. Only n rows of a group are gathered."""
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_i") <= n)
    few = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", *columns))), lambda x: F.concat_ws("|", *[x[c].cast("string") for c in columns])).alias("examples"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(few, keys)


def merged_counts(rows: DataFrame, day: Column, counts: str) -> DataFrame:
    """(day, key, total, n): counts given as JSON maps {key: number}, added up by day."""
    parts = rows.select(day.alias("day"), F.explode(F.from_json(counts, "map<string,long>")).alias("key", "v"))
    return parts.groupBy("day", "key").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def half_trend(rows: DataFrame, keys: list[str], at: str, value: str, least: float) -> DataFrame:
    """(keys, first, second, trend): means before and from the middle of each group's time range, and which way they went by least."""
    span = rows.groupBy(*keys).agg(((F.unix_micros(F.min(at)) + F.unix_micros(F.max(at))) / 2).alias("mid"))
    late = F.unix_micros(at) >= F.col("mid")
    by = rows.join(span, keys).groupBy(*keys).agg(F.round(F.avg(F.when(~late, F.col(value))), 6).alias("first"), F.round(F.avg(F.when(late, F.col(value))), 6).alias("second"))
    gap = F.col("second") - F.col("first")
    return by.withColumn("trend", F.when(gap > least, "up").when(gap < -least, "down").otherwise("stable"))


def against_baseline(rows: DataFrame, keys: list[str], at: str, value: str, now: str, hours: int = 24) -> DataFrame:
    """(keys, recent, baseline, change): the mean of the last hours before now against that of as many hours before these."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at)) / (3600 * 10**6)
    two = rows.where((age >= 0) & (age < 2 * hours)).groupBy(*keys).agg(F.round(F.avg(F.when(age < hours, F.col(value))), 6).alias("recent"), F.round(F.avg(F.when(age >= hours, F.col(value))), 6).alias("baseline"))
    return two.withColumn("change", F.round((F.col("recent") - F.col("baseline")) / F.when(F.col("baseline") != 0, F.col("baseline")), 4))


def progress(chunks: DataFrame, keys: list[str], total: int) -> DataFrame:
    """(keys, done, percent, per_minute, left_s): chunks (at) done of a total, their rate, and the seconds left at that rate."""
    by = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("done"), ((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 60e6).alias("minutes"))
    rate = F.when(F.col("minutes") > 0, F.col("done") / F.col("minutes"))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0)) / rate * 60
    return by.select(*keys, "done", F.round(F.least(F.lit(100.0), 100.0 * F.col("done") / total), 2).alias("percent"), F.round(rate, 4).alias("per_minute"), F.round(left, 2).alias("left_s"))


def over_limit(events: DataFrame, key: str, at: str, per_hour: int) -> DataFrame:
    """(key, hour, n, refused): clock hours in which a key has more events than its limit."""
    by = events.groupBy(key, F.date_trunc("hour", at).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return by.where(F.col("n") > per_hour).withColumn("refused", F.col("n") - per_hour)


def sync_report(runs: DataFrame, key: str, ok: Column, ms: str, at: str) -> DataFrame:
    """(key, runs, success, mean_ms, last_ok): how syncs went."""
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(ok.cast("int")), 6).alias("success"), F.round(F.avg(ms), 4).alias("mean_ms"), F.max(F.when(ok, F.col(at))).alias("last_ok"))


def canonical_targets(pairs: DataFrame) -> DataFrame:
    """(term, canonical, total, share): the commonest target of each term (term, target), the first by name of equals, and its share."""
    by = pairs.groupBy("term", "target").agg(F.count(F.lit(1)).alias("k"))
    out = by.groupBy("term").agg(F.min_by(F.struct("target", "k"), F.struct(-F.col("k"), "target")).alias("b"), F.sum("k").alias("total"))
    return out.select("term", F.col("b.target").alias("canonical"), "total", (F.col("b.k") / F.col("total")).alias("share"))


def page_consistency(pairs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(page, uses, inconsistent, score, passes): uses of terms on a page whose target is not the corpus's commonest one, nor part of it,
    nor a variant with three tenths of all uses or more."""
    by = pairs.groupBy("term", "target").agg(F.count(F.lit(1)).alias("k"))
    judged = by.join(canonical_targets(pairs), "term").withColumn("good", (F.col("target") == F.col("canonical")) | F.contains("canonical", "target") | F.contains("target", "canonical") | (F.col("k") / F.col("total") >= 0.3))
    uses = pairs.join(judged.select("term", "target", "good"), ["term", "target"])
    out = uses.groupBy("page").agg(F.count(F.lit(1)).alias("uses"), F.count_if(~F.col("good")).alias("inconsistent"))
    score = F.round(1 - F.col("inconsistent") / F.col("uses"), 6)
    return out.withColumns({"score": score, "passes": score >= at_least})


def term_statistics(pairs: DataFrame, sure: float = 0.8) -> DataFrame:
    """One row over (term, target, confidence): pairs, distinct terms and targets, pairs of high confidence, mean confidence."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("term").alias("terms"), F.count_distinct("target").alias("targets"), F.count_if(F.col("confidence") >= sure).alias("sure"), F.round(F.avg("confidence"), 6).alias("confidence"))


#: Frequency classes, most frequent first; the order of lanes on a timeline.
FREQUENCIES = ("very_common", "common", "uncommon", "rare")
LANES = ("person", "institution", "text", "event", "place", "concept")


def rank_in(value: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in an order, from 1; after the last where it is none of it."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)), F.lit(len(order) + 1)).cast("long")
