"""Grades of translations, calibration, alerts and chosen examples over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import grading as G
from lodestone.operators import calibration as C
from lodestone.operators import examples as E
from lodestone.operators import monitors as M
from lodestone.operators import stats as Z
from lodestone.operators import translations as T
from lodestone.session import materialised, table
from lodestone.sources.views import METRICS_SQL, translation_metrics

LATIN, MARKS, TERMS = r"[\x{00C0}-\x{00FF}]", "[éè]", ("the", "than", "une", "les", "le la", "that")
BLANK = r"[ \t\n\f\r\x0B]"


def translations(spark: SparkSession, folder: str) -> DataFrame:
    """(key, original, translation): each turn of conversations with the next one as its translation.

    After every third turn the sentences are followed by a quote of the turn; every third one gets an opening and a bracket that
    is never closed.
    """
    c = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    quote = F.concat(F.lit(". ("), F.substring("text", 1, 12), F.lit(") "))
    said = F.when(F.col("turn") % 3 == 1, F.replace(F.col("after"), F.lit(". "), quote)).when(F.col("turn") % 3 == 2, F.concat(F.lit("Here is ("), "after")).otherwise(F.col("after"))
    return c.join(after, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("text").alias("original"), said.alias("translation"))


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """(term, english, alternates): words of four letters or more of benchmark items, the word after as rendering."""
    words = table(spark, folder, "benchmark").select(F.split(F.lower("text"), r"[^a-zà-ÿ]+").alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.col("w").alias("term"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("english"))).alias("p")).select("p.term", "p.english")
    by = pairs.where((F.char_length("term") >= 4) & (F.col("english") != "")).groupBy("term").agg(F.array_sort(F.collect_set("english")).alias("e"))
    return by.select("term", F.col("e")[0].alias("english"), F.slice("e", 2, F.greatest(F.size("e"), F.lit(1))).alias("alternates"))


PAIRS_SQL = """t AS (SELECT conv_id || '-' || turn AS key, text AS original, CASE turn % 3 WHEN 1 THEN replace(after, '. ', '. (' || text[1:12] || ') ') WHEN 2 THEN 'Here is (' || after ELSE after END AS translation
  FROM (SELECT a.conv_id, a.turn, a.text, b.text AS after FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1))"""
HITS_SQL = """dw AS (SELECT regexp_split_to_array(lower(text), '[^a-zà-ÿ]+') AS w FROM benchmark), dp AS (SELECT unnest(w) AS term, unnest(list_append(w[2:], NULL)) AS english FROM dw),
d AS (SELECT term, min(english) AS english, list(DISTINCT english) AS words FROM dp WHERE length(term) >= 4 AND english <> '' GROUP BY term),
ht AS (SELECT key, term, english, words, translation, row_number() OVER (PARTITION BY key ORDER BY length(term) DESC, term) AS i FROM t JOIN d ON contains(original, term)),
h AS (SELECT key, count(*) AS terms, count(*) FILTER (len(list_filter(words, lambda x: contains(lower(translation), x))) > 0) AS matched, count(*) FILTER (contains(lower(translation), english) OR contains(translation, term)) AS used FROM ht WHERE i <= 20 GROUP BY key)"""


def _clipped(x: str, low: str, high: str) -> str:
    return f"greatest(least({x}, {high}::DOUBLE), {low}::DOUBLE)"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


QUOTE, ROUND = rf"\([^)]*{LATIN}[^)]*\)", r"\([^)]*\)"
PIECES = rf"list_filter(regexp_split_to_array(translation, '[.!?]+'), lambda s: regexp_matches(s, '[^ \t\n\f\r\x0B]'))"
BARE = rf"regexp_replace(translation, '{ROUND}', '', 'g')"
TRIMMED = r"trim(translation, E' \t\n\x0B\f\r')"
OPENED = " OR ".join([*[f"starts_with(lower({TRIMMED}), '{o}')" for o in G.OPENINGS], f"contains(lower({TRIMMED}), '{G.ANYWHERE}')"])
FAILED = " OR ".join(f"contains(translation, '{f}')" for f in G.FAILURES)
HELD = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(translation), '{x}') THEN '{x}' END" for x in TERMS) + "], lambda x: x IS NOT NULL)"
AWKWARD = " ".join(rf"- CASE WHEN regexp_matches(translation, '(?i)\b({a})\b') THEN 0.05::DOUBLE ELSE 0 END" for a in G.AWKWARD)
GRADED_SQL = rf"""{PAIRS_SQL}, {HITS_SQL}, j AS (SELECT key, original, translation, coalesce(terms, 0) AS terms, coalesce(matched, 0) AS matched, coalesce(used, 0) AS used FROM t LEFT JOIN h USING (key)),
m AS (SELECT *, {_n("translation", QUOTE)} AS quotes, {PIECES} AS pieces, {_n("original", MARKS)} AS had, {_n(f"array_to_string(regexp_extract_all(translation, '{QUOTE}'), ' ')", MARKS)} AS kept,
  length({BARE}) / nullif(length(original), 0)::DOUBLE AS ratio, {_n("translation", "[.!?]+")} AS ends, {_n("original", "[.!?]+")} AS own_ends, {_n("translation", r"[.!?]" + BLANK + "*" + ROUND)} AS tied,
  length(regexp_replace({BARE}, '{BLANK}+', ' ', 'g')) AS here, length(regexp_replace(original, '{BLANK}+', ' ', 'g')) AS there, {HELD} AS held, list_transform(regexp_extract_all(translation, '\b[A-Z][a-z]+(?:{BLANK}+[A-Z][a-z]+)*\b'), lambda x: lower(x)) AS capital FROM j),
p AS (SELECT *, CASE WHEN had = 0 THEN 1 ELSE greatest(least(kept / had, 1) - least(abs(had - kept) * 0.1::DOUBLE, 0.3::DOUBLE), 0) END AS marks_kept,
  greatest(1 - CASE WHEN {_n("translation", r"\(")} <> {_n("translation", r"\)")} THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN {OPENED} THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN {_n(BARE, LATIN)} > 2 THEN 0.2::DOUBLE ELSE 0 END
  - CASE WHEN ends = 0 AND length(translation) > 50 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN {_n("translation", r"\)" + BLANK + r"*\(")} > 3 THEN 0.1::DOUBLE ELSE 0 END, 0) AS form, list_transform(pieces, lambda s: lower(regexp_extract(s, '[^ \t\n\f\r\x0B]+'))) AS firsts FROM m),
a AS (SELECT key, terms, matched, used,
  {_clipped(rf"0.5 + least(quotes * 0.025::DOUBLE, 0.15::DOUBLE) + 0.15::DOUBLE * coalesce(len(list_filter(pieces, lambda s: regexp_matches(s, '{QUOTE}'))) / nullif(len(pieces), 0), 0) + CASE WHEN ratio BETWEEN 0.5 AND 3 THEN 0.1::DOUBLE WHEN ratio BETWEEN 0.3::DOUBLE AND 4 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN {FAILED} THEN 0 ELSE 0.05::DOUBLE END + 0.15::DOUBLE * coalesce(matched / nullif(terms, 0), 0.5::DOUBLE) + 0.1::DOUBLE * marks_kept + 0.1::DOUBLE * form", "0.1", "0.98")} AS confidence,
  {_clipped("0.7::DOUBLE + least(used * 0.05::DOUBLE, 0.3::DOUBLE) - CASE WHEN quotes > 0 THEN 0 ELSE 0.2::DOUBLE END", "0", "1")} AS usage,
  {_clipped(rf"0.8::DOUBLE - CASE WHEN least(ends, own_ends) / nullif(greatest(ends, own_ends), 0) < 0.8::DOUBLE THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN tied / nullif(ends, 0) < 0.7::DOUBLE THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(translation, '(?m)^{BLANK}*[*•-]') THEN 0.1::DOUBLE ELSE 0 END", "0", "1")} AS structure,
  {_clipped("0.8::DOUBLE - least(len(list_intersect(held, capital)) * 0.1::DOUBLE, 0.3::DOUBLE) - CASE WHEN len(held) > 0 THEN 0.1::DOUBLE ELSE 0 END", "0", "1")} AS terminology,
  {_clipped(rf"0.8::DOUBLE - CASE WHEN here * 2 < there THEN 0.3::DOUBLE WHEN here > there * 3 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN regexp_matches({TRIMMED}, '[^.!?]\z') THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(translation, '{LATIN}{{5,}}') THEN 0.4::DOUBLE ELSE 0 END", "0", "1")} AS completeness,
  {_clipped(rf"0.7::DOUBLE {AWKWARD} - CASE WHEN list_sum(list_transform(pieces, lambda s: {_n('s', BLANK + '+')} + 1)) / nullif(len(pieces), 0) > 30 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN list_max(map_values(list_histogram(firsts))) > 3 THEN 0.1::DOUBLE ELSE 0 END", "0", "1")} AS naturalness FROM p),
g AS (SELECT *, round(0.2::DOUBLE * usage + 0.25::DOUBLE * structure + 0.2::DOUBLE * terminology + 0.2::DOUBLE * completeness + 0.15::DOUBLE * naturalness, 9) AS overall FROM a)"""
GRADE = "CASE WHEN overall >= 0.9::DOUBLE THEN 'Excellent' WHEN overall >= 0.75::DOUBLE THEN 'Good' WHEN overall >= 0.6::DOUBLE THEN 'Fair' ELSE 'Poor' END"
WORK = "concat_ws(',', " + ", ".join(f"CASE WHEN round({k}, 9) < {v}::DOUBLE THEN '{k}' END" for k, v in G.FLOORS.items()) + ")"


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    return T.graded(translations(spark, folder), dictionary(spark, folder), LATIN, MARKS, TERMS)


def cases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as cases, their items' parts as expected entities (the fifth items without a name), most of them found under other spellings."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "hard").when(F.substring("o_orderpriority", 1, 1) == "3", "medium").otherwise("easy").alias("difficulty"))
    items = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    expected = items.select(F.col("l_orderkey").alias("case_id"), F.col("p_type").alias("type"), F.when(F.col("l_linenumber") == 5, "UNKNOWN").otherwise(F.col("p_name")).alias("name"))
    found = items.where("l_quantity > 15").select(
        F.col("l_orderkey").alias("case_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("found_id"), F.when(F.col("l_returnflag") == "R", "SMALL").otherwise(F.col("p_type")).alias("type"),
        F.array("p_brand", F.when(F.col("l_suppkey") % 4 == 0, "nobody").otherwise(F.concat(F.upper("p_name"), F.lit("!")))).alias("names"), (1 - F.round(F.col("l_discount") * 100) * 0.04).alias("confidence"),
    ).distinct()
    return o, expected, found


PLAIN = r"regexp_replace(regexp_replace(trim(lower({0}), E' \t\n\x0B\f\r'), '[^a-z0-9_ \t\n\f\r\x0B]', '', 'g'), '[ \t\n\f\r\x0B]+', ' ', 'g')"
CASES_SQL = f"""cs AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'hard' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'easy' END AS difficulty FROM orders),
it AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey), ex AS (SELECT l_orderkey AS case_id, p_type AS type, CASE WHEN l_linenumber = 5 THEN '?' ELSE {PLAIN.format("p_name")} END AS key FROM it),
fo AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT AS found_id, CASE WHEN l_returnflag = 'R' THEN 'SMALL' ELSE p_type END AS type, p_brand AS a, CASE WHEN l_suppkey % 4 = 0 THEN 'nobody' ELSE upper(p_name) || '!' END AS b, 1 - round(l_discount * 100) * 0.04::DOUBLE AS confidence FROM it WHERE l_quantity > 15),
fk AS (SELECT DISTINCT case_id, found_id, type, confidence, unnest([{PLAIN.format("a")}, {PLAIN.format("b")}, '?']) AS key FROM fo),
ne AS (SELECT case_id, count(*) AS expected, count(*) FILTER ((case_id, type, key) IN (SELECT (case_id, type, key) FROM fk)) AS met FROM ex GROUP BY case_id), nf AS (SELECT case_id, count(*) AS found, count(*) FILTER (confidence > 0.8::DOUBLE) AS sure FROM fo GROUP BY case_id),
nr AS (SELECT case_id, count(DISTINCT found_id) AS right_ FROM fk WHERE confidence > 0.8::DOUBLE AND (case_id, type, key) IN (SELECT (case_id, type, key) FROM ex) GROUP BY case_id),
al AS (SELECT case_id, difficulty, coalesce(expected, 0) AS e, coalesce(found, 0) AS f, coalesce(sure, 0) AS s, coalesce(met, 0) AS m, coalesce(right_, 0) AS r FROM cs LEFT JOIN ne USING (case_id) LEFT JOIN nf USING (case_id) LEFT JOIN nr USING (case_id)),
pr AS (SELECT case_id, difficulty, CASE WHEN e = 0 AND f = 0 THEN 1 ELSE coalesce(m / nullif(f, 0), 0) END AS precision, CASE WHEN e = 0 AND f = 0 THEN 1 ELSE coalesce(m / nullif(e, 0), 0) END AS recall, CASE WHEN e = 0 AND f = 0 THEN 1 WHEN f = 0 THEN 0 WHEN s = 0 THEN 1 ELSE r / s END AS confidence_accuracy FROM al),
sc AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) >= 0.7::DOUBLE AS passed FROM pr)"""


def _scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    o, expected, found = cases(spark, folder)
    return materialised(C.case_scores(o, expected, found)), expected


#: Days of events; limits so that each rule is broken on some day and kept on another.
LIMITS = {"confidence": 0.43, "quality": 0.49, "low_share": 0.71, "trend": 0.02, "drop": 0.02, "avg_ms": 510, "p95_ms": 1500, "api_ms": 320, "per_minute": 0.23, "slower": 0.1, "error_warning": 0.18, "error_critical": 0.21, "recurring": 18, "spike": 1.25, "spike_least": 12}


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day as metrics of translations, two in three with an agreement."""
    k = F.col("k")
    return materialised(translation_metrics(spark, folder).select(
        F.date_diff("ts", F.lit("1970-01-01").cast("date")).cast("long").alias("period"), "ts", F.col("event_id").alias("id"), "confidence", (k / 100.0).alias("quality"), F.when(k % 3 != 0, k / 100.0).alias("agreement"), "ms", (F.col("ms") * (k % 4 + 1) / 4.0).alias("api_ms"), "error_type",
    ))


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    return M.alerts(_daily(spark, folder), 1440, **LIMITS)


def _rule(cat: str, kind: str, sev: str, metric: str, bad: str, value: str, limit: str, source: str = "w", subject: str = "NULL::VARCHAR") -> str:
    return f"SELECT period, '{cat}' AS category, '{kind}' AS kind, '{sev}' AS severity, '{metric}' AS metric, {subject} AS subject, round(({value})::DOUBLE, 6) AS value, round(({limit})::DOUBLE, 6) AS threshold FROM {source} WHERE {bad}"


_L = {k: f"{v}::DOUBLE" for k, v in (M.LIMITS | LIMITS).items()}
RULES_SQL = " UNION ALL ".join(
    [
        _rule("quality", "confidence_drop", "critical", "confidence", f"c < {_L['confidence']}", "c", _L["confidence"]),
        _rule("quality", "quality_degradation", "warning", "quality", f"q > 0 AND q < {_L['quality']}", "q", _L["quality"]),
        _rule("quality", "high_failure_rate", "warning", "low_share", f"low > {_L['low_share']}", "low", _L["low_share"]),
        _rule("quality", "quality_degradation", "warning", "trend", f"second - first < -{_L['trend']}", "c", _L["confidence"]),
        _rule("quality", "confidence_drop", "critical", "drop", f"c0 - c > {_L['drop']}", "c", f"c0 - {_L['drop']}"),
        _rule("quality", "quality_degradation", "warning", "quality_drop", f"q0 > 0 AND q > 0 AND q0 - q > {_L['drop']}", "q", f"q0 - {_L['drop']}"),
        _rule("performance", "threshold_exceeded", "warning", "avg_ms", f"t > {_L['avg_ms']}", "t", _L["avg_ms"]),
        _rule("performance", "threshold_exceeded", "critical", "p95_ms", f"p95 > {_L['p95_ms']}", "p95", _L["p95_ms"]),
        _rule("performance", "threshold_exceeded", "warning", "api_ms", f"api > {_L['api_ms']}", "api", _L["api_ms"]),
        _rule("performance", "degradation", "warning", "per_minute", f"n / 1440 < {_L['per_minute']}", "n / 1440", _L["per_minute"]),
        _rule("performance", "spike_detected", "critical", "slower", f"t0 > 0 AND t - t0 > {_L['slower']} * t0", "t", f"t0 * (1 + {_L['slower']})"),
        _rule("error", "high_error_rate", "critical", "error_rate", f"r >= {_L['error_critical']}", "r", _L["error_critical"]),
        _rule("error", "high_error_rate", "warning", "error_rate", f"r >= {_L['error_warning']} AND r < {_L['error_critical']}", "r", _L["error_warning"]),
        _rule("error", "error_spike", "critical", "spike", f"r0 > 0 AND r >= {_L['spike']} * r0", "r", f"{_L['spike']} * r0"),
        _rule("error", "recurring_error", "warning", "count", f"i <= 5 AND n >= {_L['recurring']}", "n", _L["recurring"], "k", "error_type"),
        _rule("error", "error_spike", "warning", "count", f"n >= {_L['spike']} * n0 AND n >= {_L['spike_least']}", "n", f"{_L['spike']} * n0", "k", "error_type"),
    ]
)
ALERTS_SQL = f"""{METRICS_SQL}, e AS (SELECT *, date_diff('day', DATE '1970-01-01', ts::DATE) AS period, k / 100.0::DOUBLE AS quality, ms * (k % 4 + 1) / 4.0::DOUBLE AS api_ms FROM tm), o AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY period) AS nn FROM e),
b AS (SELECT period, count(*) AS n, avg(confidence) AS c, avg(quality) AS q, count(*) FILTER (confidence < 0.6::DOUBLE) / count(*) AS low, avg(confidence) FILTER (i <= nn // 2) AS first, avg(confidence) FILTER (i > nn // 2) AS second, avg(ms) AS t, quantile_disc(ms, 0.95) AS p95, avg(api_ms) AS api, count(error_type) / count(*) AS r FROM o GROUP BY period),
w AS (SELECT b.*, z.c AS c0, z.q AS q0, z.t AS t0, z.r AS r0 FROM b LEFT JOIN b z ON z.period = b.period - 1), kk AS (SELECT period, error_type, count(*) AS n FROM e WHERE error_type IS NOT NULL GROUP BY ALL),
k AS (SELECT kk.*, z.n AS n0, row_number() OVER (PARTITION BY kk.period ORDER BY kk.n DESC, kk.error_type) AS i FROM kk LEFT JOIN kk z ON z.period = kk.period - 1 AND z.error_type = kk.error_type), al AS ({RULES_SQL})"""


def examples(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Inputs and library: all vectors with their labels and the words of the document of their number; inputs are the stated ids
    divisible by 50, mixed with themselves backwards; some have no direction (zeros), some neither vector nor a known word."""
    v = table(spark, folder, "embeddings").join(table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.filter(F.array_distinct(F.split(F.lower("text"), r"[^a-zà-ÿ]+")), lambda w: w != "").alias("keywords")), "vec_id", "left")
    library = v.select(F.col("vec_id").alias("example_id"), F.col("label").cast("string").alias("category"), "embedding", "keywords")
    i = F.col("vec_id")
    mixed = F.zip_with("embedding", F.reverse("embedding"), lambda x, y: x.cast("double") + 0.28 * y.cast("double"))
    inputs = v.where(i % 50 == 0).select(i.alias("query_id"), F.when(i % 250 == 50, F.lit(None)).when(i % 150 == 0, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(mixed).alias("embedding"), F.when(i % 250 == 50, F.array(F.lit("0"))).otherwise(F.col("keywords")).alias("keywords"))
    return inputs, library


EXAMPLES_SQL = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label::VARCHAR AS category, coalesce(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')), lambda w: w <> ''), []) AS kw FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
q AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 250 = 50 OR vec_id % 150 = 0 THEN NULL ELSE list_transform(list_zip(e, list_reverse(e)), lambda z: z[1] + 0.28::DOUBLE * z[2]) END AS e, CASE WHEN vec_id % 250 = 50 THEN ['0'] ELSE kw END AS kw FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS example_id, category, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM q, v WHERE q.e IS NOT NULL), n AS (SELECT * FROM s WHERE score >= 0.3::DOUBLE),
kq AS (SELECT query_id, kw, len(kw) AS a FROM q WHERE query_id NOT IN (SELECT query_id FROM n)), ks AS (SELECT query_id, vec_id AS example_id, category, round(coalesce(len(list_intersect(kq.kw, v.kw)) / nullif(a, 0), 0), 9) AS score FROM kq, v),
kt AS (SELECT * FROM ks WHERE query_id IN (SELECT query_id FROM ks WHERE score > 0)), u AS (SELECT *, 'vectors' AS way FROM n UNION ALL SELECT *, 'keywords' FROM kt), b AS (SELECT *, CASE WHEN category = '3' THEN round(score * 1.2::DOUBLE, 9) ELSE score END AS x FROM u),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY x DESC, example_id) AS i FROM b), p AS (SELECT query_id, way, row_number() OVER (PARTITION BY query_id ORDER BY (i > 2)::INT, x DESC, example_id) AS place, example_id FROM i),
c AS (SELECT category, row_number() OVER (ORDER BY min(vec_id)) - 1 AS c, count(*) OVER () AS n FROM v GROUP BY category),
fr AS (SELECT vec_id, c, n, row_number() OVER (PARTITION BY category ORDER BY vec_id) AS r FROM v JOIN c USING (category)), f AS (SELECT vec_id, row_number() OVER (ORDER BY c + n * (r - 1)) AS place FROM fr WHERE c + n * (r - 1) < 4)"""

QUERIES = {
    "ma6_text_confidence": (lambda s, d: _graded(s, d).select("key", "terms", "matched", F.round("confidence", 6).alias("confidence")), f"WITH {GRADED_SQL} SELECT key, terms, matched, round(confidence, 6) AS confidence FROM g"),
    "ma10_five_aspects": (
        lambda s, d: _graded(s, d).select("key", "used", *[F.round(k, 6).alias(k) for k in (*G.WEIGHTS, "overall")], "grade", "to_work_on"),
        f"WITH {GRADED_SQL} SELECT key, used, {', '.join(f'round({k}, 6) AS {k}' for k in (*G.WEIGHTS, 'overall'))}, {GRADE} AS grade, {WORK} AS to_work_on FROM g",
    ),
    "ag27_case_scores": (
        lambda s, d: C.case_scores(*cases(s, d)).select("case_id", "difficulty", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "confidence_accuracy")], "passed"),
        f"WITH {CASES_SQL} SELECT case_id, difficulty, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(confidence_accuracy, 6) AS confidence_accuracy, passed FROM sc",
    ),
    "ag27_calibration": (
        lambda s, d: C.calibration(*_scores(s, d)),
        f"""WITH {CASES_SQL}, k AS (SELECT 'all' AS scope, 'all' AS value, * FROM sc UNION ALL SELECT 'difficulty', difficulty, * FROM sc UNION ALL SELECT 'type', type, sc.* FROM sc JOIN (SELECT DISTINCT case_id, type FROM ex) USING (case_id))
SELECT scope, value, count(*) AS cases, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(avg(passed::INT), 6) AS pass_rate, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(confidence_accuracy), 6) AS confidence_accuracy FROM k GROUP BY ALL""",
    ),
    "ma13_monitor_alerts": (_alerts, f"WITH {ALERTS_SQL} SELECT * FROM al"),
    "st6_alert_counts": (lambda s, d: M.alert_counts(_alerts(s, d)), f"WITH {ALERTS_SQL} SELECT period, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning FROM al GROUP BY period"),
    "ag6_quality_summary": (
        lambda s, d: M.quality_summary(_daily(s, d), 0.01),
        f"""WITH {METRICS_SQL}, e AS (SELECT *, date_diff('day', DATE '1970-01-01', ts::DATE) AS period, CASE WHEN k % 3 <> 0 THEN k / 100.0::DOUBLE END AS agreement FROM tm), o AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY period) AS nn FROM e),
b AS (SELECT period, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(k / 100.0::DOUBLE), 6) AS quality, round(coalesce(avg(agreement), 0), 6) AS agreement, round(count(*) FILTER (confidence >= 0.8::DOUBLE) / count(*), 6) AS high, round(count(*) FILTER (confidence >= 0.6::DOUBLE AND confidence < 0.8::DOUBLE) / count(*), 6) AS medium,
  round(count(*) FILTER (confidence < 0.6::DOUBLE) / count(*), 6) AS low, avg(confidence) FILTER (i > nn // 2) - avg(confidence) FILTER (i <= nn // 2) AS step FROM o GROUP BY period) SELECT * EXCLUDE (step), CASE WHEN step > 0.01::DOUBLE THEN 'improving' WHEN step < -0.01::DOUBLE THEN 'degrading' ELSE 'stable' END AS trend FROM b""",
    ),
    "ag9_stats_with_trend": (
        lambda s, d: (lambda m: Z.linear_stats(m, ["metric_name"]).join(Z.halves_trend(m, ["metric_name"], ["ts", "event_id"], relative=0.01).select("metric_name", "trend"), "metric_name"))(materialised(translation_metrics(s, d).select("metric_name", "ts", "event_id", "value"))),
        f"""WITH {METRICS_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY metric_name) AS nn FROM tm),
b AS (SELECT metric_name, count(value) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, avg(value) FILTER (i <= nn // 2) AS x, avg(value) FILTER (i > nn // 2) AS y FROM w GROUP BY metric_name)
SELECT * EXCLUDE (x, y), CASE WHEN (y - x) / x > 0.01::DOUBLE THEN 'degrading' WHEN (y - x) / x < -0.01::DOUBLE THEN 'improving' ELSE 'stable' END AS trend FROM b""",
    ),
    "sx1_examples": (lambda s, d: E.select_examples(*examples(s, d), count=4, prefer="3"), f"WITH {EXAMPLES_SQL} SELECT query_id, way, place::INT AS place, example_id FROM p WHERE place <= 4 UNION ALL SELECT query_id, 'default', place::INT, vec_id FROM kq, f WHERE query_id NOT IN (SELECT query_id FROM kt)"),
}
