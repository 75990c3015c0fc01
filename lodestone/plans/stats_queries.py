"""Metrics, review and terminology queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import stats as A
from lodestone.session import table
from lodestone.sources.views import METRICS_SQL, NODES_SQL, REVIEW_SQL, TERMS_SQL, kg_nodes, review_queue, term_pairs, translation_metrics


def _events(f):
    return lambda spark, folder: f(translation_metrics(spark, folder).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "user": F.col("user_id") % 50}))


def _reviews(f):
    return lambda spark, folder: f(review_queue(spark, folder))


def _terms(f):
    return lambda spark, folder: f(term_pairs(spark, folder))


TM = f"WITH {METRICS_SQL}, e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, user_id % 50 AS user FROM tm)"
RQ = f"WITH {REVIEW_SQL}"
TP = f"WITH {TERMS_SQL}"
_BUCKET = {"hour": "strftime(ts, '%Y-%m-%d %H:00')", "day": "strftime(ts, '%Y-%m-%d')", "week": "year(ts) || '-W' || strftime(ts, '%V')"}

QUERIES = {
    "ag9_stats_linear": (_events(lambda e: A.linear_stats(e, ["metric_name"])), f"{TM} SELECT metric_name, count(value) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM e GROUP BY metric_name"),
    "ag10_stats_nearest": (_events(lambda e: A.nearest_stats(e, ["metric_name"])), f"{TM} SELECT metric_name, count(value) AS n, round(avg(value), 6) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM e GROUP BY metric_name"),
    "ag10_metric_trends": (
        _events(lambda e: A.trended_stats(e, ["metric_name", "day"], ["ts", "event_id"])),
        f"""{TM}, w AS (SELECT *, row_number() OVER (PARTITION BY metric_name, day ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY metric_name, day) AS n FROM e),
h AS (SELECT metric_name, day, count(value) AS n, avg(value) AS m, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, avg(value) FILTER (i <= floor(n / 2)) AS a, avg(value) FILTER (i > floor(n / 2)) AS b FROM w GROUP BY metric_name, day)
SELECT metric_name, day, n, round(m, 6) AS avg, p50, p95, p99, min, max, CASE WHEN (b - a) / a > 0.1 THEN 'degrading' WHEN (b - a) / a < -0.1 THEN 'improving' ELSE 'stable' END AS trend FROM h""",
    ),
    "ag7_bottlenecks": (
        _events(lambda e: A.bottlenecks(e.withColumn("api_ms", F.floor(F.col("ms") * (F.col("event_id") % 5 + 3) / 10)), ["day"])),
        f"""{TM}, b AS (SELECT day, avg(ms) AS m, avg(floor(ms * (event_id % 5 + 3) / 10)) AS api FROM e GROUP BY day)
SELECT day, 'api' AS phase, round(api, 6) AS avg_ms, round(100.0::DOUBLE * api / m, 6) AS share FROM b UNION ALL SELECT day, 'processing', round(m - api, 6), round(100.0::DOUBLE * (m - api) / m, 6) FROM b""",
    ),
    "ag29_activity_by_tag": (
        _events(lambda e: A.activity_by(e.withColumn("tag", F.col("k")), ["tag"], F.col("event_id") % 3 > 0)),
        f"{TM} SELECT k AS tag, count(*) AS requests, count(error_type) AS errors, round(count(error_type) / count(*), 6) AS error_rate, round(count(*) FILTER (event_id % 3 > 0) / count(*), 6) AS hit_rate, coalesce(round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 9), 0.0) AS per_second FROM e GROUP BY k",
    ),
    "ag11_query_stats": (_events(lambda e: A.performance_report(e, ["metric_name"])), f"{TM} SELECT metric_name, count(*) AS n, round(avg(ms), 6) AS avg, quantile_disc(ms::DOUBLE, 0.5) AS p50, quantile_disc(ms::DOUBLE, 0.95) AS p95, quantile_disc(ms::DOUBLE, 0.99) AS p99, min(ms) AS min, max(ms) AS max, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7), 6) AS per_minute FROM e GROUP BY metric_name"),
    "ag12_stddev": (_events(lambda e: e.groupBy("metric_name").agg(F.round(F.stddev_pop("value"), 6).alias("sd"))), f"{TM} SELECT metric_name, round(stddev_pop(value), 6) AS sd FROM e GROUP BY metric_name"),
    "wn1_moving_average": (
        _events(lambda e: A.moving_average(e, ["metric_name", "day"], ["ts", "event_id"], width=5).select("event_id", "metric_name", F.round("moving", 6).alias("moving"))),
        f"{TM}, w AS (SELECT event_id, metric_name, avg(value) OVER (PARTITION BY metric_name, day ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS moving, row_number() OVER (PARTITION BY metric_name, day ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY metric_name, day) AS n FROM e) SELECT event_id, metric_name, round(moving, 6) AS moving FROM w WHERE i >= least(5, n)",
    ),
    "wn2_trend_halves": (
        _events(lambda e: A.halves_trend(e, ["metric_name", "day"], ["ts", "event_id"])),
        f"""{TM}, w AS (SELECT *, row_number() OVER (PARTITION BY metric_name, day ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY metric_name, day) AS n FROM e),
h AS (SELECT metric_name, day, avg(value) FILTER (i <= floor(n / 2)) AS a, avg(value) FILTER (i > floor(n / 2)) AS b FROM w GROUP BY metric_name, day)
SELECT metric_name, day, round(a, 6) AS first, round(b, 6) AS second, CASE WHEN (b - a) / a > 0.05 THEN 'degrading' WHEN (b - a) / a < -0.05 THEN 'improving' ELSE 'stable' END AS trend FROM h""",
    ),
    "wn3_outliers": (
        _events(lambda e: A.outliers(e, ["metric_name"]).select("event_id", "metric_name", F.round("z", 5).alias("z"))),
        f"{TM}, s AS (SELECT metric_name, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY metric_name) SELECT event_id, metric_name, round(abs(value - m) / s, 5) AS z FROM e JOIN s USING (metric_name) WHERE abs(value - m) / s >= 2.5",
    ),
    **{f"ag13_bucket_{u}": (_events(lambda e, u=u: A.bucketed(e, u)), f"{TM} SELECT {b} AS bucket, count(*) AS n, round(avg(value), 6) AS avg, round(sum(value), 4) AS total FROM e GROUP BY 1") for u, b in _BUCKET.items()},
    "ag14_by_tag": (lambda s, d: A.by_tag(table(s, d, "events"), "$.k"), "SELECT props->>'$.k' AS tag, count(*) AS n, round(avg(value), 6) AS avg FROM events WHERE props->>'$.k' IS NOT NULL GROUP BY 1"),
    "ag15_rate": (_events(lambda e: A.rate(e, ["metric_name"])), f"{TM} SELECT metric_name, count(*) AS n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS per_second FROM e GROUP BY metric_name"),
    "ag2_confidence_buckets": (
        _events(lambda e: e.groupBy(A.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))),
        f"{TM} SELECT CASE WHEN confidence < 0.3 THEN 'very_low' WHEN confidence < 0.5 THEN 'low' WHEN confidence < 0.7 THEN 'medium' WHEN confidence < 0.9 THEN 'high' ELSE 'very_high' END AS bucket, count(*) AS n FROM e GROUP BY 1",
    ),
    "ag3_global_counts": (
        _events(lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("avg"), F.count_if(F.col("confidence") < 0.5).alias("low"), F.count_if(F.col("confidence") > 0.9).alias("high"))),
        f"{TM} SELECT count(*) AS n, round(avg(confidence), 6) AS avg, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (confidence > 0.9) AS high FROM e",
    ),
    "ag6_quality_report": (_events(lambda e: A.quality_report(e, ["day"])), f"{TM} SELECT day, count(*) AS n, round(avg(confidence), 6) AS avg, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.6) AS low FROM e GROUP BY day"),
    "ag7_performance_report": (_events(lambda e: A.performance_report(e, ["day"])), f"{TM} SELECT day, count(*) AS n, round(avg(ms), 6) AS avg, quantile_disc(ms::DOUBLE, 0.5) AS p50, quantile_disc(ms::DOUBLE, 0.95) AS p95, quantile_disc(ms::DOUBLE, 0.99) AS p99, min(ms) AS min, max(ms) AS max, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7), 6) AS per_minute FROM e GROUP BY day"),
    "ag8_error_summary": (
        _events(A.error_summary),
        f"""{TM}, x AS (SELECT error_type, event_id, row_number() OVER (PARTITION BY error_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY error_type) AS n, count(*) OVER () AS total FROM e WHERE error_type IS NOT NULL)
SELECT error_type, max(n) AS n, round(100.0::DOUBLE * max(n) / max(total), 4) AS share, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (i <= 3) AS examples FROM x GROUP BY error_type ORDER BY n DESC, error_type LIMIT 5""",
    ),
    "ag16_gate_breakdown": (
        _events(A.gate_breakdown),
        f"{TM} SELECT gate, count(*) AS n, round(avg(p::INT), 6) AS pass_rate FROM (SELECT 'confidence' AS gate, k >= 30 AS p FROM e UNION ALL SELECT 'format', k % 2 = 0 FROM e UNION ALL SELECT 'preservation', k % 5 <> 0 FROM e) GROUP BY gate",
    ),
    "ag17_review_metrics": (
        _reviews(lambda r: A.review_metrics(r, ["severity"])),
        f"{RQ} SELECT severity, count(*) AS n, count(reviewed) AS reviewed, round(avg((epoch_us(reviewed) - epoch_us(created)) / 6e7), 6) AS turnaround, round(count(*) FILTER (status = 'approved') / count(reviewed), 6) AS approval, round(count(*) FILTER (status = 'rejected') / count(reviewed), 6) AS rejection FROM rq GROUP BY severity",
    ),
    "ag18_weekly_report": (
        _reviews(lambda r: A.review_metrics(r.withColumn("week", A.bucket(F.col("created"), "week")), ["week"])),
        f"{RQ} SELECT year(created) || '-W' || strftime(created, '%V') AS week, count(*) AS n, count(reviewed) AS reviewed, round(avg((epoch_us(reviewed) - epoch_us(created)) / 6e7), 6) AS turnaround, coalesce(round(count(*) FILTER (status = 'approved') / nullif(count(reviewed), 0), 6), 0.0) AS approval, coalesce(round(count(*) FILTER (status = 'rejected') / nullif(count(reviewed), 0), 6), 0.0) AS rejection FROM rq GROUP BY 1",
    ),
    "ag19_queue_stats": (_reviews(A.queue_stats), f"{RQ} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM rq"),
    "tk4_pending_reviews": (_reviews(A.pending_reviews), f"{RQ} SELECT id, severity, strftime(created, '%Y-%m-%d') AS created FROM rq WHERE status = 'pending' ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rq.created, id LIMIT 50"),
    "ag17_top_reasons": (_reviews(A.top_reasons), f"{RQ} SELECT reason, count(*) AS n FROM rq GROUP BY reason ORDER BY n DESC, reason LIMIT 5"),
    "ag28_health_score": (
        lambda s, d: kg_nodes(s, d).agg(F.count_if(F.col("confidence") < 0.5).alias("low"), F.count_if((F.col("confidence") > 0.9) & ~F.col("verified")).alias("hi"), F.count_if(F.col("death") < F.col("birth")).alias("contra")).select(A.health_score(F.col("low"), F.col("contra"), F.col("hi")).alias("score")),
        f"WITH {NODES_SQL} SELECT 100.0::DOUBLE - least(2.0 * count(*) FILTER (confidence < 0.5), 40.0)::DOUBLE - least(5.0 * count(*) FILTER (death < birth), 30.0)::DOUBLE - least(0.5 * count(*) FILTER (confidence > 0.9 AND NOT verified), 10.0)::DOUBLE AS score FROM kg_nodes",
    ),
    "ag29_dashboard": (_events(A.dashboard), f"{TM} SELECT count(*) AS n, round(avg(ms), 6) AS avg_ms, round(quantile_cont(ms::DOUBLE, 0.95), 6) AS p95_ms, round(avg((error_type IS NOT NULL)::INT), 6) AS error_rate, round(avg((confidence >= 0.7)::INT), 6) AS pass_rate FROM e"),
    "ma13_alerts": (
        _events(lambda e: A.alerts(e, ["day"], slow_ms=2000, error_share=0.2)),
        f"""{TM}, b AS (SELECT day, avg(confidence) AS c, quantile_cont(ms::DOUBLE, 0.95) AS p, avg((error_type IS NOT NULL)::INT) AS r FROM e GROUP BY day)
SELECT day, 'quality' AS monitor, 'high' AS severity, round(c, 4) AS figure FROM b WHERE c < 0.7 UNION ALL SELECT day, 'performance', 'medium', round(p, 4) FROM b WHERE p > 2000 UNION ALL SELECT day, 'errors', 'critical', round(r, 4) FROM b WHERE r > 0.2""",
    ),
    "tk3_slow_queries": (_events(lambda e: A.slow_queries(e, 500)), f"{TM} SELECT event_id, ms FROM e WHERE ms >= 500 ORDER BY ms DESC, event_id LIMIT 50"),
    "tk1_page": (lambda s, d: A.page_of(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20), "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40"),
    "tk2_recent": (lambda s, d: table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50"),
    "ag34_heat_map": (lambda s, d: A.heat_map(kg_nodes(s, d), 25.0), f"WITH {NODES_SQL} SELECT floor(lat / 25) * 25 AS cell_lat, floor(lon / 25) * 25 AS cell_lon, count(*) AS n FROM kg_nodes WHERE lat IS NOT NULL GROUP BY 1, 2"),
    "ag22_glossary": (
        _terms(A.glossary),
        f"""{TP}, b AS (SELECT term, target, count(*) AS n FROM tp GROUP BY term, target), c AS (SELECT term, target, row_number() OVER (PARTITION BY term ORDER BY n DESC, target) AS i FROM b)
SELECT tp.term, max(c.target) AS canonical, count(DISTINCT tp.target) AS variants, count(*) AS n, count(DISTINCT page) AS pages, min(page) AS first_page, max(page) AS last_page, round(avg(confidence), 6) AS confidence FROM tp JOIN c ON c.term = tp.term AND i = 1 GROUP BY tp.term""",
    ),
    "tk9_glossary_top": (
        _terms(lambda t: A.glossary(t).withColumn("weight", F.round(F.col("n") * F.col("confidence"), 3)).orderBy(F.desc("weight"), "term").limit(30).select("term", "weight")),
        f"{TP} SELECT term, round(count(*) * round(avg(confidence), 6), 3) AS weight FROM tp GROUP BY term ORDER BY weight DESC, term LIMIT 30",
    ),
    "ag24_inconsistencies": (
        _terms(A.inconsistencies),
        f"""{TP}, b AS (SELECT term, target, count(*) AS n FROM tp GROUP BY term, target), s AS (SELECT term, n, n / sum(n) OVER (PARTITION BY term) AS p FROM b), h AS (SELECT term, count(*) AS variants, -sum(p * log2(p)) AS h FROM s GROUP BY term HAVING count(*) > 1)
SELECT term, variants, round(h, 6) AS entropy, CASE WHEN h > 2 THEN 'high' WHEN h > 1 THEN 'medium' ELSE 'low' END AS severity FROM h""",
    ),
    "wn5_diverse_top": (
        lambda s, d: A.capped_top(table(s, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_partkey", "p_brand"),
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS i FROM part) SELECT p_partkey, p_brand FROM r ORDER BY (i > 5)::INT, p_retailprice DESC, p_partkey LIMIT 10",
    ),
}
