"""Workflow, filter and mining queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import mining as M
from lodestone.operators import workflow as W
from lodestone.session import table
from lodestone.sources.views import METRICS_SQL, NODES_SQL, REVIEW_SQL, TERMS_SQL, kg_nodes, review_queue, term_pairs, translation_metrics


def _sentences(spark, folder):
    """English sentences made of supplier and nation names, one for each supplier."""
    s = table(spark, folder, "supplier").withColumn("n", F.element_at(F.array(*map(F.lit, ("Marpa", "Milarepa", "Naropa", "Tilopa", "Gampopa"))), (F.col("s_suppkey") % 5 + 1).cast("int")))
    verb = F.element_at(F.array(*map(F.lit, ("taught", "studied under", "composed", "walked past"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("doc_id"), F.concat("n", F.lit(" "), verb, F.lit(" Drogmi Lotsawa.")).alias("text"))


TM, RQ, TP = f"WITH {METRICS_SQL}", f"WITH {REVIEW_SQL}", f"WITH {TERMS_SQL}"

QUERIES = {
    "ag25_batch_status": (
        lambda s, d: W.batch_status(review_queue(s, d).withColumn("batch", F.col("id") % 3000), ["batch"]),
        f"""{RQ}, b AS (SELECT id % 3000 AS batch, count(*) AS total, count(*) FILTER (status = 'approved') AS done, count(*) FILTER (status = 'rejected') AS failed FROM rq GROUP BY 1)
SELECT batch, total, done, failed, round(100.0::DOUBLE * (done + failed) / total, 2) AS progress, CASE WHEN done + failed < total THEN 'processing' WHEN failed = 0 THEN 'completed' WHEN done = 0 THEN 'failed' ELSE 'partial' END AS status FROM b""",
    ),
    "ag21_suggested_terms": (
        lambda s, d: W.suggested_terms(term_pairs(s, d).withColumn("term", F.col("target")).withColumn("target", F.col("page").cast("string")), term_pairs(s, d).where("page = 1").select(F.col("target").alias("term")).distinct()),
        f"""{TP}, b AS (SELECT target AS term, page::VARCHAR AS target, count(*) AS n FROM tp GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, target) AS i, sum(n) OVER (PARTITION BY term) AS a FROM b)
SELECT term, target AS english, a::BIGINT AS n, round(n / a, 6) AS consistency, CASE WHEN n / a >= 0.8 THEN 'high' WHEN n / a >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM r WHERE i = 1 AND a >= 2 AND term NOT IN (SELECT target FROM tp WHERE page = 1)""",
    ),
    "sf18_learned_terms": (
        lambda s, d: W.learned_terms(*[term_pairs(s, d).where(c).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.max("page").alias("last")) for c in ("page % 2 = 0", "page % 2 = 1")]),
        f"{TP} SELECT term, count(*) AS n, round(max(confidence), 6) AS confidence, max(page) AS last FROM tp GROUP BY term",
    ),
    "ma7_consensus": (
        lambda s, d: W.consensus(translation_metrics(s, d).select("user_id", (F.col("k") % 4).alias("answer"), "confidence"), ["user_id"]),
        f"""{TM}, b AS (SELECT user_id, k % 4 AS answer, count(*) AS votes, avg(confidence) AS mean, sum(confidence) AS s FROM tm GROUP BY 1, 2), w AS (SELECT *, votes / sum(votes) OVER (PARTITION BY user_id) AS share FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s * (0.7 + 0.3 * share), 9) DESC, answer) AS i FROM w)
SELECT user_id, answer, votes, round(least(1.0, mean + CASE WHEN share >= 1 THEN 0.15 WHEN share >= 2.0 / 3 THEN 0.1 WHEN share >= 0.5 THEN 0.05 ELSE 0 END), 6) AS confidence FROM r WHERE i = 1""",
    ),
    "sx13_joined_chunks": (
        lambda s, d: W.joined_chunks(table(s, d, "conversations").withColumn("score", F.char_length("text") / 100.0), ["conv_id"], "turn", "text", "score").select("conv_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "confidence"),
        "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS sha, round(avg(length(text) / 100.0::DOUBLE), 6) AS confidence FROM conversations GROUP BY conv_id",
    ),
    "sx11_pool_status": (lambda s, d: W.pool_status(translation_metrics(s, d).withColumn("key", F.col("user_id") % 20), "key"), f"{TM} SELECT user_id % 20 AS key, count(*) AS calls, count(error_type) AS errors, round(avg(ms), 4) AS mean_ms, CASE WHEN count(error_type) > count(*) * 0.25 THEN 'limited' ELSE 'available' END AS state FROM tm GROUP BY 1"),
    "sx16_hit_rates": (lambda s, d: W.hit_rates(translation_metrics(s, d), "metric_name", F.col("k") % 3 > 0), f"{TM} SELECT metric_name, count(*) AS lookups, count(*) FILTER (k % 3 > 0) AS hits, round(count(*) FILTER (k % 3 > 0) / count(*), 6) AS rate FROM tm GROUP BY 1"),
    "ag30_regression_score": (
        lambda s, d: W.regression_score(translation_metrics(s, d).select((F.col("k") > 20).alias("passed"), (F.col("k") / 100.0).alias("similarity"), "confidence")),
        f"{TM}, r AS (SELECT 100 * (0.5::DOUBLE * avg((k > 20)::INT) + 0.3::DOUBLE * avg(k / 100.0::DOUBLE) + 0.2::DOUBLE * avg(confidence)) AS x FROM tm) SELECT round(x, 4) AS score, CASE WHEN x >= 90 THEN 'excellent' WHEN x >= 75 THEN 'good' WHEN x >= 60 THEN 'fair' ELSE 'poor' END AS verdict FROM r",
    ),
    "ag30_version_compare": (
        lambda s, d: W.compared_versions(translation_metrics(s, d).select(F.floor(F.col("event_id") / 2).alias("example"), F.when(F.col("event_id") % 2 == 0, "v1").otherwise("v2").alias("version"), (F.col("k") / 100.0).alias("similarity")), "v1", "v2"),
        f"""{TM}, b AS (SELECT event_id // 2 AS example, avg(k / 100.0::DOUBLE) FILTER (event_id % 2 = 0) AS a, avg(k / 100.0::DOUBLE) FILTER (event_id % 2 = 1) AS b FROM tm GROUP BY 1), c AS (SELECT b - a AS x FROM b WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS examples, count(*) FILTER (x >= 0.05::DOUBLE) AS improved, count(*) FILTER (x <= -0.05::DOUBLE) AS regressed, count(*) FILTER (abs(x) < 0.05::DOUBLE) AS unchanged, round(avg(x), 6) AS mean_change FROM c""",
    ),
    "sf24_query_keys": (
        lambda s, d: translation_metrics(s, d).groupBy(W.query_key(F.col("metric_name"), user=F.col("user_id") % 50, k=F.col("k")).alias("key")).agg(F.count(F.lit(1)).alias("n")),
        f"""{TM} SELECT metric_name || ':' || md5('{{"k":' || coalesce(k::VARCHAR, 'null') || ',"user":' || coalesce((user_id % 50)::VARCHAR, 'null') || '}}') AS key, count(*) AS n FROM tm GROUP BY 1""",
    ),
    "sx4_lane_classes": (
        lambda s, d: kg_nodes(s, d).groupBy("type", W.lane_class(F.col("confidence")).alias("class")).agg(F.count(F.lit(1)).alias("n")),
        f"WITH {NODES_SQL} SELECT type, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS class, count(*) AS n FROM kg_nodes GROUP BY 1, 2",
    ),
    "sx4_swim_lanes": (
        lambda s, d: kg_nodes(s, d).select("id", *[c.alias(n) for c, n in zip(W.swim_lane(F.col("birth"), F.col("founded"), F.col("occurred"), F.col("death")), ("start", "end"), strict=True)]),
        f'WITH {NODES_SQL} SELECT id, coalesce(birth, founded, occurred, 1200) AS start, coalesce(death, birth, founded, occurred, 1200) AS "end" FROM kg_nodes',
    ),
    "rm1_relations": (
        lambda s, d: M.matches(_sentences(s, d)).select("doc_id", "predicate", "subject", "object", "confidence"),
        """WITH t AS (SELECT s_suppkey AS doc_id, ['Marpa', 'Milarepa', 'Naropa', 'Tilopa', 'Gampopa'][s_suppkey % 5 + 1] AS subject, ['teacher_of', 'student_of', 'wrote', NULL][s_suppkey % 4 + 1] AS predicate, [0.9, 0.9, 0.91, NULL]::DOUBLE[] AS c FROM supplier)
SELECT doc_id, predicate, subject, 'Drogmi Lotsawa' AS object, c[doc_id % 4 + 1] AS confidence FROM t WHERE predicate IS NOT NULL""",
    ),
    "rm7_hinted_predicates": (
        lambda s, d: _sentences(s, d).select("doc_id", F.concat_ws(",", W.hinted_predicates(F.col("text"))).alias("hints")),
        "SELECT s_suppkey AS doc_id, ['teacher_of', 'student_of', 'wrote', ''][s_suppkey % 4 + 1] AS hints FROM supplier",
    ),
    "flt2_prefix": (lambda s, d: table(s, d, "part").where(F.col("p_type").startswith("S")).groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), "SELECT p_type, count(*) AS n FROM part WHERE p_type LIKE 'S%' GROUP BY p_type"),
    "flt3_in_list": (lambda s, d: table(s, d, "events").where(F.col("event_type").isin("error", "click")).select("event_id"), "SELECT event_id FROM events WHERE event_type IN ('error', 'click')"),
    "flt1_time_range": (lambda s, d: table(s, d, "events").where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-09").cast("timestamp_ntz"))).select("event_id"), "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'"),
    "flt6_contains": (lambda s, d: table(s, d, "part").where(F.col("p_name").contains("small")).orderBy("p_partkey").limit(200).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(p_name, 'small') ORDER BY p_partkey LIMIT 200"),
    "flt7_latest_errors": (lambda s, d: translation_metrics(s, d).where("error_type is not null").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "error_type"), f"{TM} SELECT event_id, error_type FROM tm WHERE error_type IS NOT NULL ORDER BY ts DESC, event_id LIMIT 20"),
    "src6_custom_query": (lambda s, d: s.sql("SELECT type, count(*) AS n FROM {nodes} WHERE confidence >= :least GROUP BY type", args={"least": 0.8}, nodes=kg_nodes(s, d)), f"WITH {NODES_SQL} SELECT type, count(*) AS n FROM kg_nodes WHERE confidence >= 0.8 GROUP BY type"),
}
