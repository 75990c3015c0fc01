"""Alerts of the three monitors (quality, performance, errors) by period, alone and against the period before.

Periods are whole numbers (days, hours); a period's figures are sums by key, so a busy period is pre-aggregated. Only the
trend needs an order: rows are counted by slices of time, and only the slice that holds the middle is ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the rules; each can be given anew.
LIMITS = {"confidence": 0.7, "quality": 0.7, "low_share": 0.15, "trend": 0.05, "drop": 0.1, "avg_ms": 30000, "p95_ms": 60000, "api_ms": 10000, "per_minute": 0.5, "slower": 0.5, "error_warning": 0.05, "error_critical": 0.1, "recurring": 5, "kinds": 5, "spike": 2.0, "spike_least": 3}


def half_means(metrics: DataFrame, slice_seconds: int = 60) -> DataFrame:
    """(period, first, second): mean confidence of the first floor(n / 2) rows of a period by (ts, id), and of the rest.

    A period of one row has no first half (null).
    """
    rows = metrics.select("period", "ts", "id", "confidence", F.floor(F.unix_micros("ts") / (slice_seconds * 1000000)).alias("slice"))
    by = rows.groupBy("period", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("sum"))
    ordered, whole = Window.partitionBy("period").orderBy("slice"), Window.partitionBy("period")
    cut = by.withColumns({"upto": F.sum("n").over(ordered), "all": F.sum("n").over(whole), "total": F.sum("sum").over(whole)}).withColumn("half", F.floor(F.col("all") / 2))
    before = cut.groupBy("period").agg(F.max("all").alias("all"), F.max("half").alias("half"), F.max("total").alias("total"), F.coalesce(F.sum(F.when(F.col("upto") <= F.col("half"), F.col("sum"))), F.lit(0.0)).alias("early"))
    middle = cut.where((F.col("upto") > F.col("half")) & (F.col("upto") - F.col("n") < F.col("half"))).select("period", "slice", (F.col("half") - F.col("upto") + F.col("n")).alias("take"))
    ranked = rows.join(middle, ["period", "slice"]).withColumn("i", F.row_number().over(Window.partitionBy("period", "slice").orderBy("ts", "id")))
    rest = ranked.where(F.col("i") <= F.col("take")).groupBy("period").agg(F.sum("confidence").alias("rest"))
    first = F.col("early") + F.coalesce("rest", F.lit(0.0))
    return before.join(rest, "period", "left").select("period", (first / F.when(F.col("half") > 0, F.col("half"))).alias("first"), ((F.col("total") - first) / (F.col("all") - F.col("half"))).alias("second"))


def period_figures(metrics: DataFrame) -> DataFrame:
    """A row for each period: means, shares, percentile (nearest rank) and errors of metrics (period, ts, id, confidence, quality, ms,
    api_ms, error_type); rows without a quality leave its mean alone."""
    n = F.count(F.lit(1))
    by = metrics.groupBy("period").agg(
        n.alias("n"), F.avg("confidence").alias("confidence"), F.avg("quality").alias("quality"), (F.count_if(F.col("confidence") < 0.6) / n).alias("low_share"), F.avg("ms").alias("avg_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"), F.avg("api_ms").alias("api_ms"), F.count("error_type").alias("errors"),
    )
    return by.join(half_means(metrics), "period").withColumn("error_rate", F.col("errors") / F.col("n"))


def quality_summary(metrics: DataFrame, change: float = 0.05) -> DataFrame:
    """(period, n, confidence, quality, agreement, high, medium, low, trend): means (rows without a quality or agreement left out; 0
    without any), shares of confidences of .8 or more, .6 or more, and less; trend: improving or degrading where the second half's
    mean confidence is over `change` above or below the first's, else stable."""
    n, c = F.count(F.lit(1)), F.col("confidence")
    mean = lambda x: F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias(x)
    share = lambda when, name: F.round(F.count_if(when) / n, 6).alias(name)
    by = metrics.groupBy("period").agg(n.alias("n"), *[mean(x) for x in ("confidence", "quality", "agreement")], share(c >= 0.8, "high"), share((c >= 0.6) & (c < 0.8), "medium"), share(c < 0.6, "low"))
    step = F.col("second") - F.col("first")
    return by.join(half_means(metrics), "period").select(*by.columns, F.when(step > change, "improving").when(step < -change, "degrading").otherwise("stable").alias("trend"))


def alerts(metrics: DataFrame, minutes: float, **limits: float) -> DataFrame:
    """(period, category, kind, severity, metric, subject, value, threshold): a row for each rule that a period breaks.

    `minutes` is a period's length. Against the period before (that with the next smaller number by one): drops of confidence and
    quality, longer times, more errors in all and of a type. A period without rows has no row, and what follows it no period before.
    Recurring errors are looked for among a period's most frequent types, ties by name. subject is the error type, else null.
    """
    unknown = set(limits) - set(LIMITS)
    if unknown:
        raise ValueError(f"no such limits: {sorted(unknown)}")
    x = LIMITS | limits
    now = period_figures(metrics)
    names = ("confidence", "quality", "avg_ms", "error_rate")
    was = now.select((F.col("period") + 1).alias("period"), *[F.col(c).alias(f"was_{c}") for c in names])
    both = now.join(was, "period", "left").withColumns({"per_minute": F.col("n") / minutes, "trend": F.col("second") - F.col("first")})
    c = F.col
    rules: list[tuple[str, str, str, str, Column, Column, Column]] = [
        ("quality", "confidence_drop", "critical", "confidence", c("confidence") < x["confidence"], c("confidence"), F.lit(x["confidence"])),
        ("quality", "quality_degradation", "warning", "quality", (c("quality") > 0) & (c("quality") < x["quality"]), c("quality"), F.lit(x["quality"])),
        ("quality", "high_failure_rate", "warning", "low_share", c("low_share") > x["low_share"], c("low_share"), F.lit(x["low_share"])),
        ("quality", "quality_degradation", "warning", "trend", c("trend") < -x["trend"], c("confidence"), F.lit(x["confidence"])),
        ("quality", "confidence_drop", "critical", "drop", c("was_confidence") - c("confidence") > x["drop"], c("confidence"), c("was_confidence") - x["drop"]),
        ("quality", "quality_degradation", "warning", "quality_drop", (c("was_quality") > 0) & (c("quality") > 0) & (c("was_quality") - c("quality") > x["drop"]), c("quality"), c("was_quality") - x["drop"]),
        ("performance", "threshold_exceeded", "warning", "avg_ms", c("avg_ms") > x["avg_ms"], c("avg_ms"), F.lit(x["avg_ms"])),
        ("performance", "threshold_exceeded", "critical", "p95_ms", c("p95_ms") > x["p95_ms"], c("p95_ms"), F.lit(x["p95_ms"])),
        ("performance", "threshold_exceeded", "warning", "api_ms", c("api_ms") > x["api_ms"], c("api_ms"), F.lit(x["api_ms"])),
        ("performance", "degradation", "warning", "per_minute", c("per_minute") < x["per_minute"], c("per_minute"), F.lit(x["per_minute"])),
        ("performance", "spike_detected", "critical", "slower", (c("was_avg_ms") > 0) & (c("avg_ms") - c("was_avg_ms") > x["slower"] * c("was_avg_ms")), c("avg_ms"), c("was_avg_ms") * (1 + x["slower"])),
        ("error", "high_error_rate", "critical", "error_rate", c("error_rate") >= x["error_critical"], c("error_rate"), F.lit(x["error_critical"])),
        ("error", "high_error_rate", "warning", "error_rate", (c("error_rate") >= x["error_warning"]) & (c("error_rate") < x["error_critical"]), c("error_rate"), F.lit(x["error_warning"])),
        ("error", "error_spike", "critical", "spike", (c("was_error_rate") > 0) & (c("error_rate") >= x["spike"] * c("was_error_rate")), c("error_rate"), x["spike"] * c("was_error_rate")),
    ]
    row = lambda cat, kind, sev, metric, value, limit, subject=None: F.struct(F.lit(cat).alias("category"), F.lit(kind).alias("kind"), F.lit(sev).alias("severity"), F.lit(metric).alias("metric"), (F.lit(None).cast("string") if subject is None else subject).alias("subject"), F.round(value.cast("double"), 6).alias("value"), F.round(limit.cast("double"), 6).alias("threshold"))
    broken = F.filter(F.array(*[F.when(bad, row(cat, kind, sev, metric, value, limit)) for cat, kind, sev, metric, bad, value, limit in rules]), lambda r: r.isNotNull())
    found = [both.select("period", F.explode(broken).alias("r"))]
    kinds = metrics.where("error_type is not null").groupBy("period", "error_type").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("n"), "error_type"))
    found.append(kinds.withColumn("i", place).where((c("i") <= x["kinds"]) & (c("n") >= x["recurring"])).select("period", row("error", "recurring_error", "warning", "count", c("n"), F.lit(x["recurring"]), c("error_type")).alias("r")))
    more = kinds.join(kinds.select((c("period") + 1).alias("period"), "error_type", c("n").alias("was")), ["period", "error_type"]).where((c("n") >= x["spike"] * c("was")) & (c("n") >= x["spike_least"]))
    found.append(more.select("period", row("error", "error_spike", "warning", "count", c("n"), x["spike"] * c("was"), c("error_type")).alias("r")))
    return reduce(DataFrame.unionByName, found).select("period", "r.*")


def combined(found: DataFrame) -> DataFrame:
    """Alerts from the newest period to the oldest, critical ones first."""
    return found.orderBy(F.desc("period"), "severity", "category", "kind", "metric", "subject")


def alert_counts(found: DataFrame) -> DataFrame:
    """(period, total, critical, warning) of alerts."""
    return found.groupBy("period").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning")])
