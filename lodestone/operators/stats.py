"""Metrics analytics: statistics by key, trends, outliers, buckets, gates, queues, alerts.

Ordered operators take the keys of their window; give keys that bound a group (a metric and a day, say).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def linear_stats(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """count, avg, min, max, p50, p95, p99 by keys; percentiles interpolate."""
    p = lambda q: _r(F.percentile(value, q)).alias(f"p{int(q * 100)}")
    return df.groupBy(*keys).agg(F.count(value).alias("n"), _r(F.avg(value)).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), p(0.5), p(0.95), p(0.99))


def nearest_stats(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """count, avg, p50, p95, p99 by keys; percentiles are values that occur (nearest rank)."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(q * 100)}")
    return df.groupBy(*keys).agg(F.count(value).alias("n"), _r(F.avg(value)).alias("avg"), p(0.5), p(0.95), p(0.99))


def numbered(df: DataFrame, keys: list[str], order: list[str], slice_size: int = 3600) -> DataFrame:
    """df with _i, a row's number from 1 in its group by order, and _n, the rows of the group.

    The first column of order, a time or a number, is cut into slices (of seconds or units). Slices are counted, their counts
    summed, and rows are ranked within their slice only: a group of any size is many tasks.
    """
    first = F.col(order[0])
    size = F.unix_micros(first) / 1e6 if df.schema[order[0]].dataType.typeName().startswith("timestamp") else first.cast("double")
    cut = df.withColumn("_s", F.floor(size / slice_size))
    by = cut.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    starts = by.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, "_s")], F.coalesce(F.sum("_c").over(w.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("_n"))
    own = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, "_s")])
    return cut.withColumn("_i", own).join(starts, same).withColumn("_i", F.col("_i") + F.col("_before")).drop("_s", "_before", *[f"_k_{c}" for c in (*keys, "_s")])


def halves_trend(df: DataFrame, keys: list[str], order: list[str], value: str = "value", relative: float = 0.05, higher_is_better: bool = False) -> DataFrame:
    """first and second: means of the first floor(n / 2) rows and of the others; trend: improving, degrading or stable."""
    ranked = numbered(df, keys, order)
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    out = ranked.groupBy(*keys).agg(F.avg(F.when(early, F.col(value))).alias("first"), F.avg(F.when(~early, F.col(value))).alias("second"))
    change = (F.col("second") - F.col("first")) / F.when(F.col("first") != 0, F.col("first"))
    up, down = ("improving", "degrading") if higher_is_better else ("degrading", "improving")
    trend = F.when(change > relative, up).when(change < -relative, down).otherwise("stable")
    return out.select(*keys, _r("first").alias("first"), _r("second").alias("second"), trend.alias("trend"))


def trended_stats(df: DataFrame, keys: list[str], order: list[str], value: str = "value", relative: float = 0.1) -> DataFrame:
    """nearest_stats with min, max and the trend of halves_trend, less being better; one row has no halves and is stable."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    trend = halves_trend(df, keys, order, value, relative).select(*keys, "trend")
    return nearest_stats(df, keys, value).join(ends, keys).join(trend, keys)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str = "value", width: int = 3, run: int = 4096) -> DataFrame:
    """df with moving: the mean of the last width values, for full windows only; width is at most the group's size.

    Rows are numbered and cut into runs; the last width - 1 rows of a run are sent to the next one too, so no group is one task.
    """
    run = max(run, width)
    at = F.floor((F.col("_i") - 1) / run)
    places = F.when((F.col("_i") - 1) % run > run - width, F.array(F.struct(at.alias("r"), F.lit(True).alias("own")), F.struct((at + 1).alias("r"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(at.alias("r"), F.lit(True).alias("own"))))
    w = Window.partitionBy(*keys, "_p.r").orderBy("_i").rowsBetween(-(width - 1), 0)
    out = numbered(df, keys, order).withColumn("_p", F.explode(places)).withColumn("moving", F.avg(value).over(w))
    return out.where(F.col("_p.own") & (F.col("_i") >= F.least(F.lit(width), F.col("_n")))).drop("_n", "_i", "_p")


def outliers(df: DataFrame, keys: list[str], value: str = "value", z: float = 2.5) -> DataFrame:
    """df's rows at least z population deviations from the mean of their group, with z; none where the deviation is 0 or a group has one row.

    Means and deviations are aggregated first and joined back, so that no group has to be sorted or held together.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_n")).where("_s > 0 and _n > 1")
    out = df.join(stats, keys).withColumn("z", F.abs(F.col(value) - F.col("_m")) / F.col("_s")).where(F.col("z") >= z)
    return out.drop("_m", "_s", "_n")


def bucket(ts: Column, unit: str) -> Column:
    """Keys of hours, days and ISO weeks; a week has the calendar year of its day."""
    if unit == "week":
        return F.format_string("%d-W%02d", F.year(ts), F.weekofyear(ts))
    return F.date_format(ts, {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd"}[unit])


def bucketed(df: DataFrame, unit: str, ts: str = "ts", value: str = "value") -> DataFrame:
    return df.groupBy(bucket(F.col(ts), unit).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), _r(F.avg(value)).alias("avg"), _r(F.sum(value), 4).alias("total"))


def by_tag(df: DataFrame, path: str, tags: str = "props", value: str = "value") -> DataFrame:
    """(tag, n, avg) by a key of a JSON column; rows without it have no tag and are left out."""
    tag = F.get_json_object(tags, path)
    return df.where(tag.isNotNull()).groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"), _r(F.avg(value)).alias("avg"))


def rate(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """per_second: rows over the seconds from the first to the last; 0 where there is no span."""
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _r(F.coalesce(F.count(F.lit(1)) / F.when(span > 0, span), F.lit(0.0)), 9).alias("per_second"))


def confidence_bucket(c: Column) -> Column:
    return F.when(c < 0.3, "very_low").when(c < 0.5, "low").when(c < 0.7, "medium").when(c < 0.9, "high").otherwise("very_high")


def quality_report(df: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    c = F.col(confidence)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _r(F.avg(c)).alias("avg"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"))


def performance_report(df: DataFrame, keys: list[str], ms: str = "ms", ts: str = "ts") -> DataFrame:
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {ms})").alias(f"p{int(q * 100)}")
    minutes = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 6e7
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _r(F.avg(ms)).alias("avg"), p(0.5), p(0.95), p(0.99), F.min(ms).alias("min"), F.max(ms).alias("max"), _r(F.count(F.lit(1)) / F.when(minutes > 0, minutes)).alias("per_minute"))


def bottlenecks(df: DataFrame, keys: list[str], ms: str = "ms", api_ms: str = "api_ms") -> DataFrame:
    """(keys, phase, avg_ms, share): mean time in the API and elsewhere, and their share of all, in percent; null where no time passed."""
    by = df.groupBy(*keys).agg(F.avg(ms).alias("all"), F.avg(api_ms).alias("api"))
    phases = F.explode(F.array(F.struct(F.lit("api").alias("phase"), F.col("api").alias("avg")), F.struct(F.lit("processing").alias("phase"), (F.col("all") - F.col("api")).alias("avg"))))
    return by.select(*keys, "all", phases.alias("p")).select(*keys, "p.phase", _r("p.avg").alias("avg_ms"), _r(100.0 * F.col("p.avg") / F.when(F.col("all") > 0, F.col("all"))).alias("share"))


def error_summary(df: DataFrame, examples: int = 3) -> DataFrame:
    """(error_type, n, share, examples): errors by type with the first examples' ids; share of all errors, in percent."""
    errors = df.where("error_type is not null")
    by = errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    # The first few of a type: taken in each of many small groups, then again; no group of a type is ever held whole.
    few = errors.select("error_type", "event_id")
    for keys in (["error_type", F.pmod(F.xxhash64("event_id"), F.lit(64)).alias("part")], ["error_type"]):
        few = few.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("event_id")), 1, examples).alias("ids")).select("error_type", F.explode("ids").alias("event_id"))
    first = few.groupBy("error_type").agg(F.concat_ws(",", F.array_sort(F.collect_list("event_id"))).alias("examples"))
    total = errors.agg(F.count(F.lit(1)).alias("all"))
    return by.join(first, "error_type").join(F.broadcast(total)).select("error_type", "n", _r(100.0 * F.col("n") / F.col("all"), 4).alias("share"), "examples").orderBy(F.desc("n"), "error_type").limit(5)


def gate_breakdown(df: DataFrame, gates: str = "gates") -> DataFrame:
    """(gate, n, pass_rate) of a map from gates to booleans."""
    return df.select(F.explode(gates).alias("gate", "passed")).groupBy("gate").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(F.col("passed").cast("int"))).alias("pass_rate"))


def review_metrics(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, mean minutes to a review, approval and rejection rates."""
    minutes = (F.unix_micros("reviewed") - F.unix_micros("created")) / 6e7
    done = F.count_if(F.col("reviewed").isNotNull())
    share = lambda s: _r(F.coalesce(F.count_if(F.col("status") == s) / F.when(done > 0, done), F.lit(0.0)))
    return reviews.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), done.alias("reviewed"), _r(F.avg(minutes)).alias("turnaround"), share("approved").alias("approval"), share("rejected").alias("rejection"))


def weekly_report(reviews: DataFrame, corrections: DataFrame) -> DataFrame:
    """review_metrics by week of reviews (created), with the corrections (created, kind) of the week: their number and that of each
    kind as `kind:n` joined by commas, by kind. Weeks with either have a row; what a week lacks is 0, empty or (turnaround) null."""
    by = corrections.groupBy(bucket(F.col("created"), "week").alias("week"), "kind").agg(F.count(F.lit(1)).alias("n"))
    told = F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce("kind", F.lit("none")), "n")))  # kinds are few: a word each
    fixed = by.groupBy("week").agg(F.sum("n").alias("corrections"), F.array_join(told, ",").alias("by_kind"))
    seen = review_metrics(reviews.withColumn("week", bucket(F.col("created"), "week")), ["week"])
    return seen.join(fixed, "week", "full_outer").fillna(0, ["n", "reviewed", "approval", "rejection", "corrections"]).fillna("", ["by_kind"])


def queue_stats(reviews: DataFrame) -> DataFrame:
    c = lambda col, v: F.count_if(F.col(col) == v).alias(v)
    return reviews.agg(F.count(F.lit(1)).alias("total"), *[c("status", s) for s in ("pending", "approved", "rejected")], *[c("severity", s) for s in ("high", "medium", "low")])


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def pending_reviews(reviews: DataFrame, limit: int = 50) -> DataFrame:
    return reviews.where("status = 'pending'").orderBy(severity_rank(F.col("severity")), "created", "id").limit(limit).select("id", "severity", F.date_format("created", "yyyy-MM-dd").alias("created"))


def top_reasons(reviews: DataFrame, limit: int = 5) -> DataFrame:
    return reviews.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(limit)


def health_score(low: Column, contradictions: Column, unverified: Column) -> Column:
    """100 less capped penalties for low confidence, contradictions and confident but unverified rows."""
    return F.lit(100.0) - F.least(2.0 * low, F.lit(40.0)) - F.least(5.0 * contradictions, F.lit(30.0)) - F.least(0.5 * unverified, F.lit(10.0))


def dashboard(df: DataFrame) -> DataFrame:
    """One row: volume, mean and p95 time, error rate, share of confidences of 0.7 or more."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("ms")).alias("avg_ms"), _r(F.percentile("ms", 0.95)).alias("p95_ms"), _r(F.avg(F.col("error_type").isNotNull().cast("int"))).alias("error_rate"), _r(F.avg((F.col("confidence") >= 0.7).cast("int"))).alias("pass_rate"),
    )


def activity_by(df: DataFrame, keys: list[str], hit: Column, ts: str = "ts") -> DataFrame:
    """(keys, requests, errors, error_rate, hit_rate, per_second) of requests; per_second is 0 where there is no span."""
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    n, errors = F.count(F.lit(1)), F.count("error_type")
    return df.groupBy(*keys).agg(n.alias("requests"), errors.alias("errors"), _r(errors / n).alias("error_rate"), _r(F.count_if(hit) / n).alias("hit_rate"), _r(F.coalesce(n / F.when(span > 0, span), F.lit(0.0)), 9).alias("per_second"))


def alerts(df: DataFrame, keys: list[str], low_confidence: float = 0.7, slow_ms: float = 10000, error_share: float = 0.1) -> DataFrame:
    """(keys, monitor, severity, figure): a row for each rule that a group breaks, of three monitors."""
    by = df.groupBy(*keys).agg(F.avg("confidence").alias("conf"), F.percentile("ms", 0.95).alias("p95"), F.avg(F.col("error_type").isNotNull().cast("int")).alias("err"))
    rule = lambda monitor, bad, severity, x: by.where(bad).select(*keys, F.lit(monitor).alias("monitor"), F.lit(severity).alias("severity"), _r(x, 4).alias("figure"))
    found = [rule("quality", F.col("conf") < low_confidence, "high", F.col("conf")), rule("performance", F.col("p95") > slow_ms, "medium", F.col("p95")), rule("errors", F.col("err") > error_share, "critical", F.col("err"))]
    return reduce(DataFrame.unionByName, found)


def slow_queries(df: DataFrame, ms: float = 1000, limit: int = 50) -> DataFrame:
    return df.where(F.col("ms") >= ms).orderBy(F.desc("ms"), "event_id").limit(limit).select("event_id", "ms")


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of the ordered rows, with the number of all rows beside each."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(total))


def heat_map(points: DataFrame, cell: float = 0.5) -> DataFrame:
    """(cell_lat, cell_lon, n) over cells of equal degrees."""
    at = lambda c: (F.floor(F.col(c) / cell) * cell).cast("double")
    return points.where("lat is not null and lon is not null").groupBy(at("lat").alias("cell_lat"), at("lon").alias("cell_lon")).agg(F.count(F.lit(1)).alias("n"))


def glossary(pairs: DataFrame) -> DataFrame:
    """(term, canonical, variants, n, pages, first_page, last_page, confidence): the commonest target of each term is canonical."""
    by = pairs.groupBy("term", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"), F.min("page").alias("p0"), F.max("page").alias("p1"))
    pages = pairs.groupBy("term", "page").agg(F.lit(1)).groupBy("term").agg(F.count("page").alias("pages"))
    terms = by.groupBy("term").agg(
        F.min_by("target", F.struct(-F.col("n"), F.col("target"))).alias("canonical"), F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n"), F.min("p0").alias("first_page"), F.max("p1").alias("last_page"), _r(F.sum("c") / F.sum("n")).alias("confidence"),
    )
    same = F.col("term").eqNullSafe(F.col("_t"))
    return terms.join(pages.withColumnRenamed("term", "_t"), same).select("term", "canonical", "variants", "n", "pages", "first_page", "last_page", "confidence")


def inconsistencies(pairs: DataFrame) -> DataFrame:
    """(term, variants, entropy, severity): terms with several targets; entropy in bits over the targets' shares."""
    by = pairs.groupBy("term", "target").agg(F.count(F.lit(1)).alias("n"))
    # H = log2(N) - sum(n log2 n) / N, in one more aggregation
    out = by.groupBy("term").agg(F.count(F.lit(1)).alias("variants"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy")).where("variants > 1")
    return out.select("term", "variants", _r("entropy").alias("entropy"), F.when(F.col("entropy") > 2, "high").when(F.col("entropy") > 1, "medium").otherwise("low").alias("severity"))


def capped_top(df: DataFrame, category: str, order: list[Column], n: int) -> DataFrame:
    """n rows with at most ceil(n / 2) of a category, filled up from the rest in order. Each category gives its n best first."""
    w = Window.partitionBy(category).orderBy(*order)
    best = df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n)
    return best.orderBy((F.col("_i") > -(-n // 2)).cast("int"), *order).limit(n).drop("_i")
