"""Text, scoring and vector queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions import text as X
from lodestone.session import table
from lodestone.sources.views import METRICS_SQL, translation_metrics

LATIN = r"[\x{00C0}-\x{00FF}]"


def _docs(f):
    return lambda spark, folder: f(table(spark, folder, "documents"))


def _scores(spark, folder):
    m = translation_metrics(spark, folder)
    return m.select("event_id", "confidence", (F.col("k") / 100.0).alias("form"), F.when(F.col("k") % 5 == 0, 0.6).otherwise(0.95).alias("kept"))


SC = f"WITH {METRICS_SQL}, s AS (SELECT event_id, confidence, k / 100.0::DOUBLE AS form, CASE WHEN k % 5 = 0 THEN 0.6 ELSE 0.95 END::DOUBLE AS kept FROM tm)"
UNIT = "CASE WHEN {0} < 0 THEN 0.0 WHEN {0} > 1 THEN 1.0 ELSE {0} END"
VEC = "list_transform(embedding, lambda x: x::DOUBLE)"

QUERIES = {
    "sf1_token_estimate": (
        _docs(lambda d: d.select("doc_id", X.token_estimate(F.col("text"), LATIN).alias("tokens"))),
        r"SELECT doc_id, (ceil(len(regexp_extract_all(text, '[\x{00C0}-\x{00FF}]')) / 4.0) + ceil(len(regexp_extract_all(regexp_replace(text, '[\x{00C0}-\x{00FF}]', ' ', 'g'), '[^\t\n\f\r\x0B ]+')) * 1.3::DOUBLE))::BIGINT AS tokens FROM documents",
    ),
    "sf6_repeated_lines": (
        _docs(X.repeated_lines),
        "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE line <> '' AND length(line) <= 100 GROUP BY doc_id, line HAVING count(*) >= 3",
    ),
    "sf11_unicode_flags": (
        _docs(lambda d: d.select("doc_id", *[c.alias(k) for k, c in X.unicode_flags(F.col("text")).items() if k in ("replacement", "control", "zero_width")])),
        r"SELECT doc_id, regexp_matches(text, '\x{FFFD}') AS replacement, regexp_matches(text, '[\x01-\x08\x0E-\x1F\x7F]') AS control, regexp_matches(text, '[\x{200B}-\x{200D}\x{FEFF}]') AS zero_width FROM documents",
    ),
    "sf12_char_classes": (
        _docs(lambda d: d.select("doc_id", *X.class_counts(F.col("text"), {"latin": "[A-Za-z]", "digit": "[0-9]", "marked": LATIN, "space": "[ \n\t]"}))),
        r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[0-9]')) AS digit, len(regexp_extract_all(text, '[\x{00C0}-\x{00FF}]')) AS marked, len(regexp_extract_all(text, '[ \n\t]')) AS space FROM documents",
    ),
    "sf16_bracket_terms": (
        _docs(lambda d: d.select("doc_id", F.explode(X.bracket_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))),
        r"SELECT trim(unnest(regexp_extract_all(text, '\(([^()]+)\)', 1)), ' ') AS term, count(*) AS n FROM documents GROUP BY 1",
    ),
    "sf17_frequency_class": (
        _docs(lambda d: d.select(F.explode(F.split(F.lower("text"), " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).groupBy(X.frequency_class(F.col("n")).alias("class")).agg(F.count(F.lit(1)).alias("words"))),
        "WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) GROUP BY w) SELECT CASE WHEN n >= 20 THEN 'very_common' WHEN n >= 10 THEN 'common' WHEN n >= 3 THEN 'uncommon' ELSE 'rare' END AS class, count(*) AS words FROM w GROUP BY 1",
    ),
    "sf23_html_text": (
        lambda s, d: table(s, d, "pages").select("page_id", F.sha2(X.strip_html(F.col("html")).cast("binary"), 256).alias("sha"), X.suspicious(F.col("html")).alias("flag")),
        r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\f\r\x0B]+', ' ', 'g'), ' ')) AS sha, regexp_matches(lower(html), '<script|javascript:|onerror\s*=|\bunion\s+select\b') AS flag FROM pages",
    ),
    "sf24_hash_duplicates": (_docs(X.hash_duplicates), "SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "ma1_cosine_top": (
        lambda s, d: S.nearest(table(s, d, "embeddings").select("vec_id", "embedding"), table(s, d, "embeddings").where("vec_id % 50 = 0").select("vec_id", "embedding"), 3),
        f"""WITH v AS (SELECT vec_id, {VEC} AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS i FROM p) SELECT query_id, vec_id, similarity FROM r WHERE i <= 3""",
    ),
    "ma9_quality_gates": (
        lambda s, d: _scores(s, d).select("event_id", F.round(S.quality(F.col("confidence"), F.col("form"), F.col("kept")), 6).alias("quality"), S.gate(F.col("confidence"), F.col("form"), F.col("kept")).alias("gate")),
        f"{SC} SELECT event_id, round(0.4::DOUBLE * confidence + 0.3::DOUBLE * form + 0.3::DOUBLE * kept, 6) AS quality, CASE WHEN confidence < 0.7 OR kept < 0.7 THEN 'reject' WHEN form < 0.8 THEN 'warn' ELSE 'pass' END AS gate FROM s",
    ),
    "ma5_confidence": (
        lambda s, d: _scores(s, d).select("event_id", F.round(S.confidence(F.col("confidence"), F.col("form"), F.col("kept"), F.col("form")), 6).alias("c")),
        f"{SC} SELECT event_id, round(least(greatest(0.5 + 0.15::DOUBLE * {UNIT.format('confidence')} + 0.1::DOUBLE * {UNIT.format('form')} + 0.1::DOUBLE * {UNIT.format('kept')} + 0.15::DOUBLE * {UNIT.format('form')}, 0.1), 0.98), 6) AS c FROM s",
    ),
    "ma12_review_needed": (
        lambda s, d: _scores(s, d).groupBy(S.review_needed(F.col("confidence"), F.col("form")).alias("severity")).agg(F.count(F.lit(1)).alias("n")),
        f"{SC} SELECT CASE WHEN confidence < 0.5 OR form < 0.5 THEN 'high' WHEN confidence < 0.7 OR form < 0.7 THEN 'medium' WHEN confidence < 0.8 THEN 'low' END AS severity, count(*) AS n FROM s GROUP BY 1",
    ),
    "ag27_precision_recall": (
        lambda s, d: S.precision_recall(table(s, d, "lineitem").where("l_quantity > 20").select("l_partkey", "l_suppkey"), table(s, d, "lineitem").where("l_discount > 0.03").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"]),
        """WITH f AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 20), g AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.03),
n AS (SELECT (SELECT count(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM g) AS g) SELECT round(tp / f, 6) AS precision, round(tp / g, 6) AS recall, round(2 * (tp / f) * (tp / g) / ((tp / f) + (tp / g)), 6) AS f1 FROM n""",
    ),
    "sx12_error_classes": (
        lambda s, d: table(s, d, "conversations").groupBy(X.error_class(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE WHEN regexp_matches(lower(text), 'rate limit|429|quota') THEN 'rate_limit' WHEN regexp_matches(lower(text), 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(lower(text), 'network|econn|socket') THEN 'network' WHEN regexp_matches(lower(text), 'parse|json|syntax') THEN 'parse' WHEN regexp_matches(lower(text), 'auth|401|403') THEN 'auth' ELSE 'unknown' END AS kind, count(*) AS n FROM conversations GROUP BY 1",
    ),
}
