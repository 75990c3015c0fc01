"""Report, record, mining and resolution-signal queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import checks as C
from lodestone.functions import dates as D
from lodestone.functions import names as N
from lodestone.functions import text as X
from lodestone.operators import graph as G
from lodestone.operators import mining as M
from lodestone.operators import records as R
from lodestone.operators import reports as P
from lodestone.operators import resolution as E
from lodestone.operators import signals as S
from lodestone.plans.relation_queries import PAIR
from lodestone.session import shared_dir, table
from lodestone.sources import dictionary
from lodestone.sources.views import KG_SQL, METRICS_SQL, NODES_SQL, REVIEW_SQL, TERMS_SQL, kg_edges, kg_nodes, review_queue, term_pairs, translation_metrics

TM, RQ, TP = f"WITH {METRICS_SQL}", f"WITH {REVIEW_SQL}", f"WITH {TERMS_SQL}"
K = "regexp_extract(id, '[0-9]+')::BIGINT"


def _key(c="id"):
    return F.regexp_extract(c, r"\d+", 0).cast("long")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _sql_list(values):
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _texts(nodes):
    """Confidences as texts, some of which are no numbers."""
    return nodes.withColumn("confidence", F.when(_key() % 7 == 0, "n/a").otherwise(F.col("confidence").cast("string")))


NAMES = ("the teacher", "Marpa", " Buddha ", "Naropa", "")
KINDS = ("A Monk of old", "monastery (ruined)", "sacred BOOK", "festival meeting", "idea", "the city")


def _raw(spark, folder):
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(k.alias("id"), _pick(KINDS, k % 6).alias("kind"), F.concat(F.lit("a"), k % 3, F.lit("; b |a"), k % 3, F.lit("||")).alias("names"), F.when(k % 4 == 0, "high").when(k % 4 == 1, F.lit("1.7")).otherwise(F.concat(F.lit("0."), k % 9)).alias("confidence"))


PEOPLE = ("Marpa", "Milarepa", "Naropa", "Tilopa", "Gampopa", "Atisha", "Virupa", "Saraha")
VERBS = {"taught": ("teacher_of", 0.9), "studied under": ("student_of", 0.9), "was the father of": ("parent_of", 0.94), "debated with": ("debated_with", 0.8), "was quietly followed by": None, "visited": ("visited", 0.87)}


def _stories(spark, folder):
    """A sentence about two people for each part; some names with a title, some misspelt."""
    k = F.col("p_partkey")
    subject = F.concat(_pick(PEOPLE, k % 8), _pick(("", " Lotsawa", "a"), k % 3))
    return table(spark, folder, "part").select(k.alias("doc_id"), F.concat(F.lit("Long ago "), subject, F.lit(" "), _pick(VERBS, k % 6), F.lit(" "), _pick(PEOPLE, F.expr("p_partkey div 8") % 8), F.lit(", it is said.")).alias("text"))


def _people(spark):
    return spark.createDataFrame([(f"e{i}", n, 0.5 + 0.05 * i) for i, n in enumerate(PEOPLE)], "id string, name string, confidence double")


STORIES = f"""st AS (SELECT p_partkey AS doc_id, {_sql_list(PEOPLE)}[p_partkey % 8 + 1] || ['', ' Lotsawa', 'a'][p_partkey % 3 + 1] AS subject, {_sql_list(v[0] if v else '' for v in VERBS.values())}[p_partkey % 6 + 1] AS predicate, {_sql_list(VERBS)}[p_partkey % 6 + 1] AS verb,
  ([{', '.join(str(v[1] if v else 0.0) for v in VERBS.values())}]::DOUBLE[])[p_partkey % 6 + 1] AS rule, {_sql_list(PEOPLE)}[p_partkey // 8 % 8 + 1] AS object, p_partkey % 8 AS s, p_partkey // 8 % 8 AS o FROM part),
ma AS (SELECT *, subject || ' ' || verb || ' ' || object AS quote FROM st WHERE predicate <> '')"""
INVERSE = "m(p, q) AS (VALUES " + ", ".join(map(str, G.INVERSES.items())) + ")"

TITLES = ("small widget", "small widgets", "red gadget", "blue anvil", "small widget")


def _two(spark, folder):
    """Customers k and k + 1 as two records of a person."""
    k = F.col("c_custkey")
    own = table(spark, folder, "customer").select(k, F.struct(
        F.concat(F.lit("c"), k).alias("id"), F.lit("person").alias("type"), F.array(_pick(TITLES, k % 5)).alias("names"), (1000 + k * 7 % 23).alias("birth"), F.when(k % 3 > 0, 1060 + k * 5 % 31).alias("death"), F.when(k % 4 > 0, F.array(F.col("c_nationkey").cast("string"))).alias("affiliations"),
        F.array("c_mktsegment").alias("traditions"), F.lit(None).cast("array<string>").alias("roles"), F.when(k % 2 == 0, "f").when(k % 6 > 1, "m").alias("gender"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("place_type"), (k % 3 == 0).alias("verified"),
    ).alias("e"))
    return own.select(F.col("c_custkey").alias("k"), F.col("e").alias("a")).join(own.select((k - 1).alias("k"), F.col("e").alias("b")), "k")


YEARS = "CASE WHEN {0} = {1} THEN 1.0 WHEN abs({0} - {1}) <= 5 THEN 0.85 WHEN abs({0} - {1}) <= 10 THEN 0.7 WHEN abs({0} - {1}) <= 20 THEN 0.5 ELSE 0.0 END::DOUBLE"
TWO = f"""e AS (SELECT c_custkey AS k, 'c' || c_custkey AS id, {_sql_list(TITLES)}[c_custkey % 5 + 1] AS nm, 1000 + c_custkey * 7 % 23 AS birth, CASE WHEN c_custkey % 3 > 0 THEN 1060 + c_custkey * 5 % 31 END AS death, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS aff, c_mktsegment AS t,
  CASE WHEN c_custkey % 2 = 0 THEN 'f' WHEN c_custkey % 6 > 1 THEN 'm' END AS g, c_custkey % 3 = 0 AS v FROM customer),
two AS (SELECT a.k, a.id AS id1, b.id AS id2, {PAIR('a.nm', 'b.nm')} AS n, {YEARS.format('a.birth', 'b.birth')} AS bd, CASE WHEN a.death IS NOT NULL AND b.death IS NOT NULL THEN {YEARS.format('a.death', 'b.death')} END AS dd,
  CASE WHEN a.aff IS NULL AND b.aff IS NULL THEN 0.5 WHEN a.aff = b.aff THEN 1.0 ELSE 0.0 END::DOUBLE AS l, CASE WHEN a.g IS NULL OR b.g IS NULL THEN NULL WHEN a.g = b.g THEN 1.0 ELSE 0.0 END::DOUBLE AS gg, (a.t = b.t)::INT::DOUBLE AS tt, a.v OR b.v AS v,
  a.birth AS ab, b.birth AS bb, a.death AS ad, b.death AS bd2, a.g AS ag, b.g AS bg FROM e a JOIN e b ON b.k = a.k + 1),
sg AS (SELECT *, round(n, 9) AS sn, round(CASE WHEN dd IS NULL THEN bd ELSE (bd + dd) / 2 END, 9) AS sd, l AS sl, round(CASE WHEN gg IS NULL THEN tt ELSE (gg + tt) / 2 END, 9) AS sa FROM two),
ov AS (SELECT *, (sn * CASE WHEN sn = 0.5 THEN 0.25 ELSE 0.5 END + sd * CASE WHEN sd = 0.5 THEN 0.1 ELSE 0.2 END + sl * CASE WHEN sl = 0.5 THEN 0.075 ELSE 0.15 END + 0.5 * 0.05 + sa * CASE WHEN sa = 0.5 THEN 0.025 ELSE 0.05 END)::DOUBLE
  / (CASE WHEN sn = 0.5 THEN 0.25 ELSE 0.5 END + CASE WHEN sd = 0.5 THEN 0.1 ELSE 0.2 END + CASE WHEN sl = 0.5 THEN 0.075 ELSE 0.15 END + 0.05 + CASE WHEN sa = 0.5 THEN 0.025 ELSE 0.05 END)::DOUBLE AS o FROM sg),
pb AS (SELECT *, round(CASE WHEN sn > 0.98 AND o < 0.9 AND sd > 0 AND sl > 0 THEN 0.92 ELSE o END::DOUBLE, 6) AS probability FROM ov),
cl AS (SELECT *, CASE WHEN probability >= 0.95 THEN 'very_high' WHEN probability >= 0.85 THEN 'high' WHEN probability >= 0.75 THEN 'medium' ELSE 'low' END AS class FROM pb)"""
SAID = "CASE class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SAID.items()) + " END"
ADVICE = "CASE class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ADVICE.items()) + " END"


def _merge(part):
    def query(spark, folder):
        nodes, edges = kg_nodes(spark, folder), kg_edges(spark, folder)
        k = _key()
        # Persons 3 go into 2, these into 1: chains.
        merges = nodes.where("type = 'person'").where((k % 10).isin(2, 3)).select(F.concat(F.lit("c"), k - 1).alias("primary"), F.col("id").alias("duplicate"))
        after, moved, history, edge_history = S.merge_applied(nodes, edges, merges)
        if part == "edges":
            return moved.select("src", "predicate", "dst")
        if part == "nodes":
            return after.select("id", "merge_status")
        back, edges_back = S.merge_undone(after, moved, history, edge_history)
        return back.select("id", F.col("merge_status").alias("what")).unionByName(edges_back.select("id", F.concat_ws(">", "src", "predicate", "dst").alias("what")))

    return query


ERA_TEXTS = [f"{part}the {names[0]}" for names, *_ in D.ERAS for part in ("in ", "early in ", "late in ")]
SIGN_TEXTS = [f"the {e} {a} year" for e in D.ELEMENTS for a in D.ANIMALS]
SIGNS = "sg AS (SELECT i, ['fire', 'earth', 'iron', 'water', 'wood'][i // 4 % 5 + 1] || ' ' || ['rabbit', 'dragon', 'snake', 'horse', 'sheep', 'monkey', 'bird', 'dog', 'pig', 'mouse', 'ox', 'tiger'][i % 12 + 1] AS sign FROM range(60) t(i)), fs AS (SELECT sign, min(i) AS i FROM sg GROUP BY sign)"


def _dictionary(spark, folder):
    """Parts as entries in a JSON file, some without a term or a translation, some lines that are no JSON."""
    k = F.col("p_partkey")
    entry = F.to_json(F.struct(F.when(k % 5 > 0, F.col("p_name")).alias("tibetan"), F.when(k % 7 > 0, F.col("p_type")).alias("english"), F.lit("general").alias("category")))
    path = f"{shared_dir(spark)}/dictionary-{uuid.uuid4().hex}"
    table(spark, folder, "part").select(F.when(k % 11 == 0, "{not json").otherwise(entry).alias("value")).write.text(path)
    good, bad = dictionary.load_dictionary(spark, path)
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _glossary(spark, folder):
    path = f"{shared_dir(spark)}/glossary-{uuid.uuid4().hex}"
    g = term_pairs(spark, folder).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("target").alias("last"))
    dictionary.export_glossary(g, path)
    return dictionary.import_glossary(spark, path, "term string, n long, last string")


def _answers(spark, folder):
    e = table(spark, folder, "events")
    return e.select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "```json\n").otherwise("Answer: "), F.lit('{"kind": "'), "event_type", F.lit('", "n": ['), F.col("event_id") % 9, F.lit(",]}"), F.when(F.col("event_id") % 2 == 0, "\n```").otherwise(" done")).alias("text"))


QUERIES = {
    "src2_single_row": (lambda s, d: kg_nodes(s, d).where("id = 'c17'").select("id", "name", "birth").limit(1), f"WITH {NODES_SQL} SELECT id, name, birth FROM kg_nodes WHERE id = 'c17'"),
    "src7_dictionary": (
        _dictionary,
        "SELECT CASE WHEN p_partkey % 11 = 0 THEN 'unparsed' WHEN p_partkey % 5 = 0 THEN 'no term' WHEN p_partkey % 7 = 0 THEN 'no translation' ELSE 'good' END AS reason, count(*) AS n FROM part GROUP BY 1",
    ),
    "src14_glossary_round_trip": (_glossary, f"{TP} SELECT term, count(*) AS n, max(target) AS last FROM tp GROUP BY term"),
    "flt4_confidence_texts": (
        lambda s, d: _texts(kg_nodes(s, d)).select("type", F.col("confidence").try_cast("double").alias("c")).groupBy("type").agg(F.count_if(F.col("c") < 0.7).alias("low"), F.count_if(F.col("c") > 0.9).alias("high"), F.count_if(F.col("c").isNull()).alias("none")),
        f"WITH {NODES_SQL}, t AS (SELECT type, CASE WHEN {K} % 7 = 0 THEN NULL ELSE confidence END AS c FROM kg_nodes) SELECT type, count(*) FILTER (c < 0.7) AS low, count(*) FILTER (c > 0.9) AS high, count(*) FILTER (c IS NULL) AS none FROM t GROUP BY type",
    ),
    "flt9_named": (
        lambda s, d: R.named(kg_nodes(s, d).withColumn("name", F.when(F.col("type") == "person", _pick(NAMES, _key() % 5)).otherwise(F.col("name")))).groupBy("type").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {NODES_SQL} SELECT type, count(*) AS n FROM kg_nodes WHERE type <> 'person' OR {K} % 5 IN (1, 3) GROUP BY type",
    ),
    "flt10_facets": (
        lambda s, d: kg_nodes(s, d).where(F.col("type").isin("person", "event") & F.coalesce("birth", "occurred").between(1100, 1900) & (F.col("confidence") >= 0.7) & (F.col("tradition").isNull() | F.col("tradition").isin("BUILDING", "MACHINERY"))).select("id"),
        f"WITH {NODES_SQL} SELECT id FROM kg_nodes WHERE type IN ('person', 'event') AND coalesce(birth, occurred) BETWEEN 1100 AND 1900 AND confidence >= 0.7 AND (tradition IS NULL OR tradition IN ('BUILDING', 'MACHINERY'))",
    ),
    "flt11_regular_records": (
        lambda s, d: R.regular(_raw(s, d)).select("id", "type", F.array_join("names", ",").alias("names"), F.round("confidence", 6).alias("confidence")),
        "SELECT s_suppkey AS id, ['person', 'institution', 'text', 'event', 'concept', 'place'][s_suppkey % 6 + 1] AS type, 'a' || s_suppkey % 3 || ',b' AS names, CASE s_suppkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE (s_suppkey % 9) / 10.0 END::DOUBLE AS confidence FROM supplier",
    ),
    "jn11_real_ids": (
        lambda s, d: R.with_real_ids(kg_edges(s, d).select("src", "predicate", "dst"), kg_nodes(s, d).where(_key() % 4 > 0).select(F.col("id").alias("temp"), F.concat(F.lit("real-"), "id").alias("real"))),
        f"WITH {KG_SQL}, ok AS (SELECT id FROM kg_nodes WHERE {K} % 4 > 0) SELECT 'real-' || src AS src, predicate, 'real-' || dst AS dst FROM kg_edges WHERE src IN (SELECT id FROM ok) AND dst IN (SELECT id FROM ok)",
    ),
    "jn14_term_lookup": (
        lambda s, d: dictionary.lookup(table(s, d, "documents"), s.createDataFrame([("the", "article"), ("und", "and"), ("des", "of the")], "tibetan string, english string")).groupBy("term", "english").agg(F.count(F.lit(1)).alias("n")),
        r"SELECT term, english, count(*) AS n FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[^\t\n\f\r\x0B ]+')) AS w FROM documents) JOIN (VALUES ('the', 'article'), ('und', 'and'), ('des', 'of the')) t(term, english) ON list_contains(w, term) GROUP BY ALL",
    ),
    "jn15_changed_pairs": (
        lambda s, d: R.changed_pairs(*[term_pairs(s, d).where(f"page % 2 = {i}").withColumn("term", F.concat("term", F.lit("-"), F.substring("target", 1, 2))) for i in (0, 1)]),
        f"{TP}, f AS (SELECT term || '-' || target[1:2] AS term, page % 2 AS h, (list(target ORDER BY page, target))[1] AS target FROM tp GROUP BY 1, 2) SELECT a.term, a.target AS old, b.target AS new FROM f a JOIN f b ON a.term = b.term AND a.h = 0 AND b.h = 1 WHERE a.target <> b.target",
    ),
    "ag4_mean_duration": (
        lambda s, d: review_queue(s, d).where("reviewed is not null").orderBy(F.desc("reviewed"), "id").limit(50).agg(F.round(F.avg((F.unix_micros("reviewed") - F.unix_micros("created")) / 1000.0), 3).alias("ms"), F.count(F.lit(1)).alias("n")),
        f"{RQ} SELECT round(avg((epoch_us(reviewed) - epoch_us(created)) / 1000.0::DOUBLE), 3) AS ms, count(*) AS n FROM (SELECT * FROM rq WHERE reviewed IS NOT NULL ORDER BY reviewed DESC, id LIMIT 50)",
    ),
    "ag5_merged_counts": (
        lambda s, d: P.merged_counts(table(s, d, "events"), F.to_date("ts"), "props"),
        "SELECT ts::DATE AS day, 'k' AS key, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1",
    ),
    "ag6_half_trend": (
        lambda s, d: P.half_trend(translation_metrics(s, d), ["metric_name"], "ts", "confidence", 0.001),
        f"{TM}, m AS (SELECT metric_name, (epoch_us(min(ts)) + epoch_us(max(ts))) / 2.0::DOUBLE AS mid FROM tm GROUP BY 1), h AS (SELECT metric_name, round(avg(confidence) FILTER (epoch_us(ts) < mid), 6) AS first, round(avg(confidence) FILTER (epoch_us(ts) >= mid), 6) AS second FROM tm JOIN m USING (metric_name) GROUP BY 1) SELECT *, CASE WHEN second - first > 0.001 THEN 'up' WHEN second - first < -0.001 THEN 'down' ELSE 'stable' END AS trend FROM h",
    ),
    "ag20_correction_patterns": (
        lambda s, d: P.first_rows(review_queue(s, d), ["reason"], ["created", "id"], ["id", "severity"]).select("reason", "n", F.array_join("examples", ",").alias("examples")),
        f"{RQ} SELECT reason, count(*) AS n, array_to_string((list(id || '|' || severity ORDER BY created, id))[1:5], ',') AS examples FROM rq GROUP BY reason",
    ),
    "ag23_glossary_summary": (
        lambda s, d: P.canonical_targets(term_pairs(s, d)).agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("uses"), F.count_if(F.col("share") < 1).alias("inconsistent"), F.round(F.avg("share"), 6).alias("consistency")),
        f"{TP}, k AS (SELECT term, target, count(*) AS k FROM tp GROUP BY ALL), t AS (SELECT term, sum(k) AS total, max(k) / sum(k) AS share FROM k GROUP BY term) SELECT count(*) AS terms, sum(total)::BIGINT AS uses, count(*) FILTER (share < 1) AS inconsistent, round(avg(share), 6) AS consistency FROM t",
    ),
    "ag31_sync_report": (
        lambda s, d: P.sync_report(translation_metrics(s, d), "metric_name", F.col("error_type").isNull() & (F.col("k") > 10), "ms", "event_id"),
        f"{TM} SELECT metric_name, count(*) AS runs, round(avg((error_type IS NULL AND k > 10)::INT), 6) AS success, round(avg(ms), 4) AS mean_ms, max(event_id) FILTER (error_type IS NULL AND k > 10) AS last_ok FROM tm GROUP BY 1",
    ),
    "ag32_term_statistics": (lambda s, d: P.term_statistics(term_pairs(s, d)), f"{TP} SELECT count(*) AS pairs, count(DISTINCT term) AS terms, count(DISTINCT target) AS targets, count(*) FILTER (confidence >= 0.8) AS sure, round(avg(confidence), 6) AS confidence FROM tp"),
    "ag33_page_consistency": (
        lambda s, d: P.page_consistency(term_pairs(s, d).withColumn("term", F.concat("term", F.lit("-"), F.col("page") % 5))),
        f"""{TP}, t AS (SELECT term || '-' || page % 5 AS term, target, page FROM tp), k AS (SELECT term, target, count(*) AS k FROM t GROUP BY ALL), c AS (SELECT term, (list(target ORDER BY k DESC, target))[1] AS canonical, sum(k) AS total FROM k GROUP BY term),
u AS (SELECT page, target = canonical OR contains(canonical, target) OR contains(target, canonical) OR k / total >= 0.3 AS good FROM t JOIN k USING (term, target) JOIN c USING (term)), r AS (SELECT page, count(*) AS uses, count(*) FILTER (NOT good) AS inconsistent FROM u GROUP BY page) SELECT *, round(1 - inconsistent / uses, 6) AS score, round(1 - inconsistent / uses, 6) >= 0.8 AS passes FROM r""",
    ),
    "tk5_next_jobs": (lambda s, d: review_queue(s, d).where("status = 'pending'").orderBy("created", "id").limit(5).select("id"), f"{RQ} SELECT id FROM rq WHERE status = 'pending' ORDER BY created, id LIMIT 5"),
    "tk6_frequent_terms": (
        lambda s, d: term_pairs(s, d).groupBy("target").agg(F.count(F.lit(1)).alias("n")).withColumn("class", X.frequency_class(F.col("n") - 25)).orderBy(P.rank_in(F.col("class"), P.FREQUENCIES), "target").limit(20).select("target", "class"),
        f"{TP}, k AS (SELECT target, count(*) - 25 AS n FROM tp GROUP BY 1), c AS (SELECT target, CASE WHEN n >= 20 THEN 1 WHEN n >= 10 THEN 2 WHEN n >= 3 THEN 3 ELSE 4 END AS r FROM k) SELECT target, ['very_common', 'common', 'uncommon', 'rare'][r] AS class FROM c ORDER BY r, target LIMIT 20",
    ),
    "tk7_similar_of_type": (
        lambda s, d: kg_nodes(s, d).where("type in ('text', 'place')").select("id", "type", F.round(N.name_similarity(N.normalised(F.col("name")), F.lit("united widget")), 6).alias("score")).where("score >= 0.2").orderBy((F.col("type") != "place").cast("int"), F.desc("score"), "id").limit(10),
        f"WITH {NODES_SQL}, x AS (SELECT id, type, round({PAIR('nm', 'q')}, 6) AS score FROM (SELECT id, type, trim(regexp_replace(lower(name), '[-_.,]', ' ', 'g')) AS nm, 'united widget' AS q FROM kg_nodes WHERE type IN ('text', 'place'))) SELECT * FROM x WHERE score >= 0.2 ORDER BY type <> 'place', score DESC, id LIMIT 10",
    ),
    "tk8_manual_reviews": (lambda s, d: review_queue(s, d).where("severity = 'high' and status = 'pending'").orderBy(F.desc("created"), "id").limit(25).select("id", "reason"), f"{RQ} SELECT id, reason FROM rq WHERE severity = 'high' AND status = 'pending' ORDER BY created DESC, id LIMIT 25"),
    "sx2_library_statistics": (
        lambda s, d: term_pairs(s, d).groupBy("term", F.when(F.char_length("target") <= 9, "simple").when(F.char_length("target") <= 12, "medium").otherwise("complex").alias("level")).agg(F.count(F.lit(1)).alias("n")),
        f"{TP} SELECT term, CASE WHEN length(target) <= 9 THEN 'simple' WHEN length(target) <= 12 THEN 'medium' ELSE 'complex' END AS level, count(*) AS n FROM tp GROUP BY ALL",
    ),
    "sx5_lanes": (
        lambda s, d: kg_nodes(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("lane", P.rank_in(F.col("type"), P.LANES)),
        f"WITH {NODES_SQL} SELECT type, count(*) AS n, list_position(['person', 'institution', 'text', 'event', 'place', 'concept'], type)::BIGINT AS lane FROM kg_nodes GROUP BY type",
    ),
    "sm3_against_baseline": (
        lambda s, d: P.against_baseline(translation_metrics(s, d), ["metric_name"], "ts", "value", "2024-01-20 00:00:00", 72),
        f"{TM}, a AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 3600e6::DOUBLE AS h FROM tm), b AS (SELECT metric_name, round(avg(value) FILTER (h < 72), 6) AS recent, round(avg(value) FILTER (h >= 72), 6) AS baseline FROM a WHERE h >= 0 AND h < 144 GROUP BY 1) SELECT *, round((recent - baseline) / nullif(baseline, 0), 4) AS change FROM b",
    ),
    "sm6_progress": (
        lambda s, d: P.progress(translation_metrics(s, d).select("user_id", F.col("ts").alias("at")), ["user_id"], 25),
        f"{TM}, p AS (SELECT user_id, count(*) AS done, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6::DOUBLE AS m FROM tm GROUP BY 1) SELECT user_id, done, round(least(100.0, 100.0::DOUBLE * done / 25), 2) AS percent, CASE WHEN m > 0 THEN round(done / m, 4) END AS per_minute, CASE WHEN m > 0 THEN round(greatest(25 - done, 0) / (done / m) * 60, 2) END AS left_s FROM p",
    ),
    "sm9_rate_limit": (
        lambda s, d: P.over_limit(translation_metrics(s, d), "metric_name", "ts", 3),
        f"{TM} SELECT metric_name, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) - 3 AS refused FROM tm GROUP BY 1, 2 HAVING count(*) > 3",
    ),
    "rm8_repaired_json": (
        lambda s, d: _answers(s, d).select("event_id", F.from_json(X.repair_json(F.col("text")), "kind string, n array<long>").alias("j")).select("event_id", "j.kind", F.col("j.n")[0].alias("n")),
        "SELECT event_id, event_type AS kind, event_id % 9 AS n FROM events",
    ),
    "rm2_matches": (
        lambda s, d: M.matches(_stories(s, d).select("doc_id", F.concat_ws(" ", "text", F.lit("Again:"), "text").alias("text"))).select("doc_id", "predicate", "subject", "object", "position", "stop"),
        f"""WITH {STORIES}, x AS (SELECT *, 'Long ago ' || quote || ', it is said.' AS t FROM ma) SELECT doc_id, predicate, subject, object, 10 + n * (length(t) + 8) AS position, 9 + length(quote) + n * (length(t) + 8) AS stop FROM x, (SELECT unnest([0, 1]) AS n)""",
    ),
    "rm3_mentions": (
        lambda s, d: M.resolved_mentions(M.matches(_stories(s, d)).select(F.explode(F.array("subject", "object")).alias("mention")), _people(s)),
        f"""WITH {STORIES}, m AS (SELECT subject AS mention, 'e' || s AS id, s FROM ma UNION SELECT object, 'e' || o, o FROM ma)
SELECT DISTINCT mention, id, CASE WHEN mention LIKE '% Lotsawa' THEN 'variant' WHEN list_contains({_sql_list(PEOPLE)}, mention) THEN 'exact' ELSE 'similar' END AS how, CASE WHEN mention LIKE '% Lotsawa' OR list_contains({_sql_list(PEOPLE)}, mention) THEN 1.0 ELSE round(1 - 1 / length(mention), 6) END::DOUBLE AS score FROM m""",
    ),
    "rm5_edges": (
        lambda s, d: M.edges(M.matches(_stories(s, d)), _people(s)),
        f"""WITH {STORIES}, {INVERSE}, f AS (SELECT doc_id, 'e' || s AS src, predicate, 'e' || o AS dst, round(rule * (0.5::DOUBLE + 0.05::DOUBLE * s + 0.5::DOUBLE + 0.05::DOUBLE * o) / 2, 6) AS confidence FROM ma WHERE s <> o)
SELECT *, confidence < 0.6 AS needs_review FROM (SELECT *, FALSE AS inverse FROM f UNION ALL SELECT doc_id, dst, q, src, confidence, TRUE FROM f JOIN m ON p = predicate)""",
    ),
    "rm6_chosen_rules": (
        lambda s, d: M.matches(_stories(s, d), M.chosen(categories=["family", "further"], predicates=["parent_of", "debated_with"])).groupBy("predicate").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {STORIES} SELECT predicate, count(*) AS n FROM ma WHERE predicate IN ('parent_of', 'debated_with') GROUP BY 1",
    ),
    "rm9_evidence": (
        lambda s, d: M.with_evidence(M.matches(_stories(s, d)).withColumns({"quote": F.when(F.col("doc_id") % 2 == 0, F.upper("quote")).otherwise(F.concat("quote", F.lit("?"))), "object": F.when(F.col("doc_id") % 9 > 0, F.col("object"))}), _stories(s, d)).select("doc_id", "predicate", "supported", "confidence"),
        f"WITH {STORIES} SELECT doc_id, predicate, doc_id % 2 = 0 AS supported, round(rule * CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE, 6) AS confidence FROM ma WHERE doc_id % 9 > 0",
    ),
    "rm7_complexity": (
        lambda s, d: M.complexity(_stories(s, d).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Although they left; she stayed.").otherwise("")))).groupBy("route").agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'model' ELSE 'rules' END AS route, count(*) AS n FROM part GROUP BY 1",
    ),
    "tr3_signs": (
        lambda s, d: table(s, d, "part").select("p_partkey", D.sign_year(_pick(SIGN_TEXTS, F.col("p_partkey") % 60), F.when(F.col("p_partkey") % 2 == 0, 1100 + F.col("p_partkey") % 700)).alias("r")).select("p_partkey", "r.year", "r.confidence"),
        f"""WITH {SIGNS}, t AS (SELECT p_partkey, {_sql_list(SIGN_TEXTS)}[p_partkey % 60 + 1] AS t, CASE WHEN p_partkey % 2 = 0 THEN 1100 + p_partkey % 700 END AS near FROM part)
SELECT p_partkey, CASE WHEN i IS NULL THEN NULL WHEN near IS NULL THEN 1027 + i + (1499 - 1027 - i) // 60 * 60 ELSE 1027 + i + floor((near - 1027 - i) / 60.0::DOUBLE + 0.5)::BIGINT * 60 END AS year, CASE WHEN i IS NULL THEN NULL WHEN near IS NULL THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence FROM t LEFT JOIN fs ON t = 'the ' || sign || ' year'""",
    ),
    "tr4_relative_dates": (
        lambda s, d: D.relative_dates(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(_pick(("after ", "before ", "30 years after ", "40 years after "), F.col("p_partkey") % 4), F.lit("Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), _pick((" died", " was born", " died", " was born"), F.col("p_partkey") % 4)).alias("text")), kg_nodes(s, d).where("type = 'person'")).select("id", "rel.year", "rel.rule"),
        f"""WITH {NODES_SQL}, p AS (SELECT p_partkey AS id, ['after_death', 'before_birth', 'years_after', 'years_after'][p_partkey % 4 + 1] AS rule, 'customer#' || lpad(p_partkey::VARCHAR, 9, '0') AS who FROM part), n AS (SELECT lower(name) AS who, birth, death FROM kg_nodes WHERE type = 'person')
SELECT id, [death + 1, birth - 1, death + 30, birth + 40][id % 4 + 1] AS year, CASE WHEN birth IS NOT NULL THEN rule END AS rule FROM p LEFT JOIN n USING (who)""",
    ),
    "tr5_eras": (
        lambda s, d: table(s, d, "part").select("p_partkey", D.era_year(_pick(ERA_TEXTS, F.col("p_partkey") % len(ERA_TEXTS))).alias("r")).select("p_partkey", "r.year", "r.confidence"),
        f"""WITH er(i, a, b, c) AS (VALUES {', '.join(str((i, a, b, c)) for i, (_, a, b, c) in enumerate(D.ERAS))}), t AS (SELECT p_partkey, p_partkey % {len(ERA_TEXTS)} // 3 AS i, lower({_sql_list(ERA_TEXTS)}[p_partkey % {len(ERA_TEXTS)} + 1]) AS t FROM part),
h AS (SELECT p_partkey, i, CASE WHEN contains(t, 'early') OR contains(t, 'beginning') THEN 2 WHEN contains(t, 'late') OR contains(t, 'end') THEN 3 ELSE 1 END AS h FROM t)
SELECT p_partkey, [(a + b) // 2, a + floor((b - a) / 5)::INT, b - floor((b - a) / 5)::INT][h]::BIGINT AS year, round(c * [0.7, 0.8, 0.8][h], 6)::DOUBLE AS confidence FROM h JOIN er USING (i)""",
    ),
    "tr6_seasons_centuries": (
        lambda s, d: table(s, d, "part").select("p_partkey", D.resolve_date(F.when(F.col("p_partkey") % 2 == 0, F.concat(_pick(("spring", "Autumn", "winter"), F.col("p_partkey") % 3), F.lit(" of "), 900 + F.col("p_partkey") % 900)).otherwise(F.concat(F.lit("in the "), _pick(("early ", "mid-", "late ", ""), F.floor(F.col("p_partkey") / 2) % 4), F.col("p_partkey") % 12 + 8, F.lit("th century")))).alias("r")).select("p_partkey", "r.year", "r.rule"),
        "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 900 + p_partkey % 900 ELSE (p_partkey % 12 + 7) * 100 + [20, 50, 80, 50][p_partkey // 2 % 4 + 1] END AS year, CASE WHEN p_partkey % 2 = 0 THEN 'season' ELSE 'century' END AS rule FROM part",
    ),
    "tr7_ages": (lambda s, d: kg_nodes(s, d).where("type = 'person'").select("id", D.age(F.col("birth"), F.lit(1500)).alias("age")), f"WITH {NODES_SQL} SELECT id, CASE WHEN birth <= 1500 THEN 1500 - birth END AS age FROM kg_nodes WHERE type = 'person'"),
    "er7_spellings": (
        lambda s, d: table(s, d, "part").select("p_partkey", N.match_type(_pick(("bla ma dorje", "sa skya", "red widget", "mar pa"), F.col("p_partkey") % 4), _pick(("lama dorje", "sakya", "red widget", "naropa"), F.col("p_partkey") % 4)).alias("m")).select("p_partkey", "m.type", F.when(F.col("m.type") != "fuzzy", F.col("m.score")).alias("score")),
        "SELECT p_partkey, ['transliteration', 'transliteration', 'exact', 'fuzzy'][p_partkey % 4 + 1] AS type, ([0.98, 0.98, 1.0, NULL]::DOUBLE[])[p_partkey % 4 + 1] AS score FROM part",
    ),
    "er9_best_of_variants": (
        lambda s, d: E.of_distinct(table(s, d, "part").select("p_partkey", "p_name"), "p_name", F.round(N.best_of_variants(F.array("p_name", F.lit("old anvil")), F.array(F.lit("small widgets"), F.lit("blue gadget"))), 6), "score").select("p_partkey", "score"),
        f"WITH n AS (SELECT DISTINCT p_name AS a FROM part), x AS (SELECT a, round(greatest({PAIR('a', 'c')}, {PAIR('a', 'd')}, {PAIR('b', 'c')}, {PAIR('b', 'd')}), 6) AS score FROM (SELECT a, 'old anvil' AS b, 'small widgets' AS c, 'blue gadget' AS d FROM n)) SELECT p_partkey, score FROM part JOIN x ON a = p_name",
    ),
    "er13_signals": (
        lambda s, d: S.compared(_two(s, d)).select("k", F.round("signals.name", 6).alias("name"), F.round("signals.date", 6).alias("date"), "signals.location", "signals.attribute"),
        f"WITH {TWO} SELECT k, round(sn, 6) AS name, round(sd, 6) AS date, sl AS location, sa AS attribute FROM cl",
    ),
    "er16_probability": (lambda s, d: S.compared(_two(s, d)).select("k", "probability", "class", "advice"), f"WITH {TWO} SELECT k, probability, class, {ADVICE} AS advice FROM cl"),
    "er17_reasons": (
        lambda s, d: S.compared(_two(s, d)).select("k", "reason", F.array_join("warnings", ",").alias("warnings")),
        f"""WITH {TWO}, r AS (SELECT *, array_to_string(list_filter([CASE WHEN sn >= 0.95 THEN 'very similar names' WHEN sn >= 0.85 THEN 'similar names' WHEN sn >= 0.7 THEN 'moderately similar names' END, CASE WHEN sd >= 0.85 THEN 'matching time periods' WHEN sd < 0.3 THEN 'different time periods' END, CASE WHEN sl >= 0.7 THEN 'shared locations' END, CASE WHEN sa >= 0.7 THEN 'similar attributes' END], lambda x: x IS NOT NULL), ', ') AS p FROM cl)
SELECT k, {SAID} || ' (' || CASE p WHEN '' THEN 'based on available data' ELSE p END || ')' AS reason, array_to_string(list_filter([CASE WHEN sn > 0.85 AND sd < 0.3 THEN 'different_periods' END, CASE WHEN sn > 0.85 AND sl < 0.3 THEN 'different_places' END, CASE WHEN sd = 0.5 THEN 'no_dates' END, CASE WHEN sl = 0.5 THEN 'no_places' END, CASE WHEN sn > 0.95 AND NOT v THEN 'unverified' END], lambda x: x IS NOT NULL), ',') AS warnings FROM r""",
    ),
    "er22_conflicts": (
        lambda s, d: S.conflicts(_two(s, d)).select("id1", "field", "severity", "value1", "value2", "advice"),
        f"""WITH {TWO} SELECT id1, 'birth' AS field, 'high' AS severity, ab::VARCHAR AS value1, bb::VARCHAR AS value2, 'check_sources' AS advice FROM two WHERE ab <> bb UNION ALL SELECT id1, 'death', 'high', ad::VARCHAR, bd2::VARCHAR, 'check_sources' FROM two WHERE ad <> bd2 UNION ALL SELECT id1, 'gender', 'medium', ag, bg, 'keep_more_confident' FROM two WHERE ag <> bg""",
    ),
    "er23_merged_edges": (
        _merge("edges"),
        f"""WITH {KG_SQL}, mv AS (SELECT id AS d, 'c' || ({K} - {K} % 10 + 1) AS p FROM kg_nodes WHERE type = 'person' AND {K} % 10 IN (2, 3)), e AS (SELECT coalesce(a.p, src) AS s, predicate, coalesce(b.p, dst) AS o, a.p IS NULL AND b.p IS NULL AS own FROM kg_edges LEFT JOIN mv a ON a.d = src LEFT JOIN mv b ON b.d = dst)
SELECT DISTINCT s AS src, predicate, o AS dst FROM e WHERE s <> o OR own""",
    ),
    "er23_merged_nodes": (_merge("nodes"), f"WITH {NODES_SQL} SELECT id, CASE WHEN type = 'person' AND {K} % 10 IN (2, 3) THEN 'merged' ELSE merge_status END AS merge_status FROM kg_nodes"),
    "er23_merge_undone": (_merge("undone"), f"WITH {KG_SQL} SELECT id, merge_status AS what FROM kg_nodes UNION ALL SELECT id, src || '>' || predicate || '>' || dst FROM kg_edges"),
}
