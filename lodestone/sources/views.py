"""Knowledge-graph, metrics, review and terminology views over the star-schema tables, and the same views as SQL text.

The tables hold no graph, so one is derived from keys by integer arithmetic. The SQL constants define the same rows for
another engine; each is a list of common table expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import spread, table

NODE_COLUMNS = ("id", "type", "name", "tradition", "birth", "death", "founded", "occurred", "written", "lat", "lon", "confidence", "verified", "merge_status")


def _nodes(df: DataFrame, prefix: str, kind: str, key: str, name: Column, **given: Column) -> DataFrame:
    k = F.col(key).cast("long")
    null = {c: F.lit(None).cast("double" if c in ("lat", "lon") else "string" if c == "tradition" else "long") for c in NODE_COLUMNS[3:11]}
    cols = null | given
    return df.select(
        F.concat(F.lit(prefix), k).alias("id"), F.lit(kind).alias("type"), name.alias("name"), *[cols[c].alias(c) for c in NODE_COLUMNS[3:11]],
        given["confidence"].alias("confidence"), (k % 3 == 0).alias("verified"), F.when(k % 97 == 0, "merged").otherwise("active").alias("merge_status"),
    )


def kg_nodes(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    share = lambda key, base, mod: F.lit(base) + (F.col(key) % mod) / F.lit(100.0)
    long = lambda c: c.cast("long")
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    parts = [
        _nodes(t("customer"), "c", "person", "c_custkey", F.col("c_name"), tradition=F.col("c_mktsegment"), birth=1000 + c % 900, death=1040 + c % 900 + c % 50, confidence=share("c_custkey", 0.5, 50)),
        _nodes(t("supplier"), "s", "institution", "s_suppkey", F.col("s_name"), founded=900 + F.col("s_suppkey") % 700, confidence=share("s_suppkey", 0.6, 40)),
        _nodes(t("nation"), "n", "place", "n_nationkey", F.col("n_name"), lat=(n * 5 % 120 - 60).cast("double"), lon=(n * 13 % 360 - 180).cast("double"), confidence=F.lit(0.9)),
        _nodes(t("region"), "r", "place", "r_regionkey", F.col("r_name"), confidence=F.lit(0.95)),
        _nodes(t("part"), "p", "text", "p_partkey", F.col("p_name"), written=1100 + F.col("p_partkey") % 800, confidence=share("p_partkey", 0.5, 50)),
        _nodes(t("orders"), "o", "event", "o_orderkey", F.concat(F.lit("order "), "o_orderkey"), occurred=long(F.year("o_orderdate")), confidence=share("o_orderkey", 0.7, 30)),
    ]
    return reduce(DataFrame.unionByName, parts)


NODES_SQL = """
kg_nodes AS (
  SELECT 'c' || c_custkey AS id, 'person' AS type, c_name AS name, c_mktsegment AS tradition, 1000 + c_custkey % 900 AS birth, 1040 + c_custkey % 900 + c_custkey % 50 AS death,
    NULL::BIGINT AS founded, NULL::BIGINT AS occurred, NULL::BIGINT AS written, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, 0.5::DOUBLE + (c_custkey % 50)::DOUBLE / 100.0::DOUBLE AS confidence,
    c_custkey % 3 = 0 AS verified, CASE WHEN c_custkey % 97 = 0 THEN 'merged' ELSE 'active' END AS merge_status FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'institution', s_name, NULL, NULL, NULL, 900 + s_suppkey % 700, NULL, NULL, NULL, NULL, 0.6::DOUBLE + (s_suppkey % 40)::DOUBLE / 100.0::DOUBLE, s_suppkey % 3 = 0, CASE WHEN s_suppkey % 97 = 0 THEN 'merged' ELSE 'active' END FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'place', n_name, NULL, NULL, NULL, NULL, NULL, NULL, (n_nationkey * 5 % 120 - 60)::DOUBLE, (n_nationkey * 13 % 360 - 180)::DOUBLE, 0.9::DOUBLE, n_nationkey % 3 = 0, CASE WHEN n_nationkey % 97 = 0 THEN 'merged' ELSE 'active' END FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'place', r_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.95::DOUBLE, r_regionkey % 3 = 0, CASE WHEN r_regionkey % 97 = 0 THEN 'merged' ELSE 'active' END FROM region
  UNION ALL SELECT 'p' || p_partkey, 'text', p_name, NULL, NULL, NULL, NULL, NULL, 1100 + p_partkey % 800, NULL, NULL, 0.5::DOUBLE + (p_partkey % 50)::DOUBLE / 100.0::DOUBLE, p_partkey % 3 = 0, CASE WHEN p_partkey % 97 = 0 THEN 'merged' ELSE 'active' END FROM part
  UNION ALL SELECT 'o' || o_orderkey, 'event', 'order ' || o_orderkey, NULL, NULL, NULL, NULL, year(o_orderdate)::BIGINT, NULL, NULL, NULL, 0.7::DOUBLE + (o_orderkey % 30)::DOUBLE / 100.0::DOUBLE, o_orderkey % 3 = 0, CASE WHEN o_orderkey % 97 = 0 THEN 'merged' ELSE 'active' END FROM orders
)"""


def kg_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(id, src, predicate, dst, confidence)."""
    t = lambda n: table(spark, folder, n)
    ref = lambda p, k: F.concat(F.lit(p), F.col(k).cast("long") if isinstance(k, str) else k.cast("long"))
    customers, parts = t("customer").select("c_custkey"), t("part").select("p_partkey")
    n_customers = customers.agg(F.max("c_custkey").alias("top"))
    n_parts = parts.agg(F.max("p_partkey").alias("top"))
    c, p = F.col("c_custkey"), F.col("p_partkey")
    edge = lambda df, predicate, src, dst, conf: df.select(src.alias("src"), F.lit(predicate).alias("predicate"), dst.alias("dst"), conf.alias("confidence"))
    lines = t("lineitem")
    wrote = spread(lines.select("l_suppkey", "l_partkey", "l_discount"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg((F.sum(F.round(F.lit(100) - F.col("l_discount") * 100).cast("long")) / F.count(F.lit(1)) / F.lit(100.0)).alias("conf"))
    mentions = spread(lines.select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").distinct()
    pupil = customers.where("c_custkey >= 2").select(F.expr("c_custkey div 2").alias("i"), "c_custkey")
    found = [
        edge(t("nation"), "within", ref("n", "n_nationkey"), ref("r", "n_regionkey"), F.lit(0.99)),
        edge(t("customer"), "lived_at", ref("c", "c_custkey"), ref("n", "c_nationkey"), F.lit(0.8) + (c % 20) / F.lit(100.0)),
        edge(t("supplier"), "located_at", ref("s", "s_suppkey"), ref("n", "s_nationkey"), F.lit(0.9)),
        edge(t("orders"), "attended", ref("c", "o_custkey"), ref("o", "o_orderkey"), F.lit(0.7)),
        edge(wrote, "wrote", ref("s", "l_suppkey"), ref("p", "l_partkey"), F.col("conf")),
        edge(mentions, "mentions", ref("o", "l_orderkey"), ref("p", "l_partkey"), F.lit(0.6)),
        edge(pupil, "teacher_of", ref("c", "i"), ref("c", "c_custkey"), F.lit(0.9) + (F.col("i") % 10) / F.lit(100.0)),
        edge(pupil.where("c_custkey % 2 = 0"), "student_of", ref("c", "c_custkey"), ref("c", "i"), F.lit(0.9) + (F.col("i") % 10) / F.lit(100.0)),
        edge(parts.where("p_partkey >= 1"), "cites", ref("p", "p_partkey"), ref("p", F.expr("p_partkey div 2")), F.lit(0.8)),
        edge(parts.where("p_partkey % 11 = 0").join(F.broadcast(n_parts), p + 7 <= F.col("top")), "cites", ref("p", "p_partkey"), ref("p", p + 7), F.lit(0.75)),
        edge(customers.where("c_custkey % 1000 < 900").join(F.broadcast(n_customers), c + 100 <= F.col("top")), "incarnation_of", ref("c", c + 100), ref("c", "c_custkey"), F.lit(0.85)),
    ]
    return reduce(DataFrame.unionByName, found).select(F.concat_ws(":", "predicate", "src", "dst").alias("id"), "src", "predicate", "dst", "confidence")


EDGES_SQL = """
kg_raw AS (
  SELECT 'n' || n_nationkey AS src, 'within' AS predicate, 'r' || n_regionkey AS dst, 0.99::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'lived_at', 'n' || c_nationkey, 0.8::DOUBLE + (c_custkey % 20)::DOUBLE / 100.0::DOUBLE FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'located_at', 'n' || s_nationkey, 0.9::DOUBLE FROM supplier
  UNION ALL SELECT 'c' || o_custkey, 'attended', 'o' || o_orderkey, 0.7::DOUBLE FROM orders
  UNION ALL SELECT 's' || l_suppkey, 'wrote', 'p' || l_partkey, sum(round(100 - l_discount * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE / 100.0::DOUBLE FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'mentions', 'p' || l_partkey, 0.6::DOUBLE FROM lineitem
  UNION ALL SELECT 'c' || (c_custkey // 2), 'teacher_of', 'c' || c_custkey, 0.9::DOUBLE + ((c_custkey // 2) % 10)::DOUBLE / 100.0::DOUBLE FROM customer WHERE c_custkey >= 2
  UNION ALL SELECT 'c' || c_custkey, 'student_of', 'c' || (c_custkey // 2), 0.9::DOUBLE + ((c_custkey // 2) % 10)::DOUBLE / 100.0::DOUBLE FROM customer WHERE c_custkey >= 2 AND c_custkey % 2 = 0
  UNION ALL SELECT 'p' || p_partkey, 'cites', 'p' || (p_partkey // 2), 0.8::DOUBLE FROM part WHERE p_partkey >= 1
  UNION ALL SELECT 'p' || p_partkey, 'cites', 'p' || (p_partkey + 7), 0.75::DOUBLE FROM part WHERE p_partkey % 11 = 0 AND p_partkey + 7 <= (SELECT max(p_partkey) FROM part)
  UNION ALL SELECT 'c' || (c_custkey + 100), 'incarnation_of', 'c' || c_custkey, 0.85::DOUBLE FROM customer WHERE c_custkey % 1000 < 900 AND c_custkey + 100 <= (SELECT max(c_custkey) FROM customer)
), kg_edges AS (SELECT predicate || ':' || src || ':' || dst AS id, * FROM kg_raw)"""

KG_SQL = f"{NODES_SQL}, {EDGES_SQL}"


def dated_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges with years, and with faults put in: a few unknown predicates, missing ends and edges to themselves."""
    k, p = F.regexp_extract("src", r"\d+", 0).cast("long"), F.col("predicate")
    return kg_edges(spark, folder).select(
        "id", "src", F.when((p == "cites") & (k % 5 == 4), "commentary_on").when((p == "mentions") & (k % 100 == 2), "alludes_to").otherwise(p).alias("predicate"),
        F.when((p == "within") & (k % 10 == 0), F.col("src")).when((p == "attended") & (k % 100 == 1), F.concat(F.lit("x"), k)).otherwise(F.col("dst")).alias("dst"), "confidence",
        F.when(p == "lived_at", 1000 + k * 37 % 900).when(p == "attended", 1990).cast("long").alias("year"),
    )


DATED_SQL = f"""{KG_SQL}, dated AS (
  SELECT id, src, CASE WHEN predicate = 'cites' AND k % 5 = 4 THEN 'commentary_on' WHEN predicate = 'mentions' AND k % 100 = 2 THEN 'alludes_to' ELSE predicate END AS predicate,
    CASE WHEN predicate = 'within' AND k % 10 = 0 THEN src WHEN predicate = 'attended' AND k % 100 = 1 THEN 'x' || k ELSE dst END AS dst, confidence,
    CASE predicate WHEN 'lived_at' THEN 1000 + k * 37 % 900 WHEN 'attended' THEN 1990 END::BIGINT AS year FROM (SELECT *, regexp_extract(src, '[0-9]+')::BIGINT AS k FROM kg_edges))"""


def translation_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """events as translation metrics: confidence, time, error type, pass or fail by gate."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, folder, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric_name"), "value", F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"), F.floor(F.col("value") * 10).alias("ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("event_id") % 4)).alias("error_type"), k.alias("k"), F.col("user_id"),
        F.create_map(F.lit("confidence"), k >= 30, F.lit("format"), k % 2 == 0, F.lit("preservation"), k % 5 != 0).alias("gates"),
    )


METRICS_SQL = """
tm AS (
  SELECT event_id, ts, event_type AS metric_name, value, least(1.0::DOUBLE, value / 100.0::DOUBLE) AS confidence, floor(value * 10)::BIGINT AS ms,
    CASE WHEN event_type = 'error' THEN 'E' || (event_id % 4) END AS error_type, (props->>'$.k')::BIGINT AS k, user_id FROM events
)"""


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    level = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(level.isin("1", "2"), "high").when(level.isin("3", "4"), "medium").otherwise("low").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending").alias("status"), F.col("o_orderdate").alias("created"),
        F.when(F.col("o_orderstatus") != "O", F.timestamp_add("MINUTE", F.col("o_orderkey") % 4320, F.col("o_orderdate"))).alias("reviewed"), F.concat(F.lit("reason "), F.col("o_custkey") % 7).alias("reason"),
    )


REVIEW_SQL = """
rq AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] IN ('3', '4') THEN 'medium' ELSE 'low' END AS severity,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status, o_orderdate AS created,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(o_orderkey % 4320) END AS reviewed, 'reason ' || (o_custkey % 7) AS reason FROM orders
)"""


def term_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(term, target, page, confidence): parts as pairs of a source term and its translation on a page."""
    p = table(spark, folder, "part")
    return p.select(F.col("p_type").alias("term"), F.col("p_name").alias("target"), F.col("p_size").cast("long").alias("page"), (F.lit(0.5) + (F.col("p_partkey") % 50) / F.lit(100.0)).alias("confidence"))


TERMS_SQL = """
tp AS (SELECT p_type AS term, p_name AS target, p_size::BIGINT AS page, 0.5::DOUBLE + (p_partkey % 50)::DOUBLE / 100.0::DOUBLE AS confidence FROM part)"""


def laid_out(spark: SparkSession, folder: str) -> DataFrame:
    """The words of documents as items on pages (doc_id, page, n, text, x, y, width, height): eight words a line, fifty lines a page,
    and for each third document two columns of four words a line. Places are in points; the blanks between words vary."""
    words = table(spark, folder, "documents").select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).alias("n", "text"))
    two = F.col("doc_id") % 3 == 0
    per = F.when(two, 4).otherwise(8)
    row = F.floor(F.col("n") / per)
    spot, line = F.col("n") % per, F.when(two, F.floor(row % 100 / 2)).otherwise(row % 50)
    x = F.when(two, row % 2 * 300).otherwise(0) + spot * 44.0 + F.char_length("text") % 3 + 50
    y = 700.0 - line * 12 - F.when(line % 10 == 9, 8).otherwise(0) + spot % 2
    return words.select("doc_id", F.floor(row / F.when(two, 100).otherwise(50)).alias("page"), F.col("n").cast("long").alias("n"), "text", x.alias("x"), y.alias("y"), (F.least(F.char_length("text"), F.lit(8)) * 5.25).alias("width"), F.lit(10.0).alias("height"))
