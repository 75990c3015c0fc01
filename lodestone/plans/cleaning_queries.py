"""Artifacts of pages, kinds of errors, names, journeys and dates of cycles over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import checks as K
from lodestone.functions import dates as D
from lodestone.functions import errors as X
from lodestone.operators import artifacts as A
from lodestone.operators import graph as G
from lodestone.operators import stats as Z
from lodestone.session import table
from lodestone.sources.views import DATED_SQL, NODES_SQL, REVIEW_SQL, dated_edges, kg_nodes, review_queue

LATIN = r"[\x{00C0}-\x{00FF}]"


def paged(spark: SparkSession, folder: str) -> DataFrame:
    """documents with a line put in at each line's end: rights, a number of a page, a mark of a draft, or a header of many characters."""
    k = F.col("doc_id") % 5
    put = F.when(k == 0, "\n  Copyright 2001 \n \n").when(k == 1, F.concat(F.lit("\n Page "), F.col("doc_id") % 90, F.lit("\n"))).when(k == 2, "\nDRAFT\n\n").when(k == 3, "\n\n7 of 9\nchapter header of the book \n").otherwise("  \n")
    return table(spark, folder, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), put).alias("text"))


PAGED_SQL = r"""pg AS (SELECT doc_id, replace(text, chr(10), CASE doc_id % 5 WHEN 0 THEN E'\n  Copyright 2001 \n \n' WHEN 1 THEN E'\n Page ' || doc_id % 90 || E'\n' WHEN 2 THEN E'\nDRAFT\n\n' WHEN 3 THEN E'\n\n7 of 9\nchapter header of the book \n' ELSE E'  \n' END) AS text FROM documents),
ln AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM pg), ow AS (SELECT doc_id, len(l) AS lines, trim(unnest(l), E' \t\x0B\f\r') AS own FROM ln), cn AS (SELECT doc_id, own AS line, count(*) AS n, max(lines) AS lines FROM ow WHERE own <> '' AND length(own) <= 100 GROUP BY doc_id, own HAVING count(*) >= 3),
ar AS (SELECT doc_id, line, n, CASE WHEN regexp_matches(line, '(?i)^(\d+|page \d+|\d+ of \d+)$') THEN 'page-number' WHEN regexp_matches(line, '(?i)copyright|©|all rights reserved') THEN 'footer' WHEN regexp_matches(line, '(?i)draft|confidential|proprietary') THEN 'watermark' WHEN length(line) < 50 THEN 'header' ELSE 'unknown' END AS kind,
  round(least(least(n * 10 / lines, 0.5) + CASE WHEN length(line) < 30 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(line, '(?i)page|copyright|draft|header|footer') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(line, '^\d+$') THEN 0.4::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(line, '(?i)DRAFT|CONFIDENTIAL|PROPRIETARY') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(line, '(?i)copyright|©|\d+ of \d+') THEN 0.4::DOUBLE ELSE 0 END, 1), 9) AS confidence FROM cn),
bd AS (SELECT doc_id, list(DISTINCT lower(line)) AS bad FROM ar WHERE confidence > 0.7::DOUBLE GROUP BY doc_id), fl AS (SELECT doc_id, list_transform(l, lambda x: CASE WHEN list_contains(coalesce(bad, []), lower(trim(x, E' \t\x0B\f\r'))) OR regexp_matches(trim(x, E' \t\x0B\f\r'), '(?i)^(\d+|page\s+\d+|\d+\s+of\s+\d+)$') THEN NULL ELSE x END) AS l FROM ln LEFT JOIN bd USING (doc_id)),
jn AS (SELECT doc_id, len(list_filter(l, lambda x: x IS NULL)) AS dropped, array_to_string(list_transform(l, lambda x: coalesce(x, chr(57344))), chr(10)) AS t FROM fl),
cl AS (SELECT doc_id, dropped, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^[ \t\n\f\r\x0B]*\x{E000}[ \t\n\f\r\x0B\x{E000}]*$', '', 'g'), '\n{3,}', E'\n\n', 'g'), '(?m)[ \t\f\r\x0B]+$', '', 'g'), E' \t\x0B\f\r\n') AS text FROM jn)"""

_FIRST = ("Request", "Config file", "Quota exceeded", "Parse step", "The DNS lookup", "Translation failed", "No text", "Safety check", "SQL statement", "Capacity test", "User abort", "Job")
_SECOND = ("timed out", "was blocked", "is unavailable", "gave an invalid format", "had low quality", "needs an API key", "went well", "met an unsupported file", "had its environment changed")
_CODES = ("", "etimedout", "DB_LOCK", "NETWORK_DOWN", "VALIDATION_ERROR", "TRANSLATION_ERROR", "EXIT")
_STATUS = (0, 0, 0, 0, 429, 503, 400, 0, 401, 0, 200)


def _pick(values: tuple, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def error_log(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, message, code, status): events as errors with messages put together from two halves, codes and statuses."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    return e.select("event_id", F.concat_ws(" ", _pick(_FIRST, i), F.col("event_type"), _pick(_SECOND, F.floor(i / 7))).alias("message"), _pick(_CODES, F.floor(i / 3)).alias("code"), F.when(F.col("user_id") % 4 != 1, _pick(_STATUS, F.floor(i / 5))).alias("status"))


def _listed(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


LOG_SQL = f"""lg AS (SELECT event_id, {_listed(_FIRST)}[event_id % {len(_FIRST)} + 1] || ' ' || event_type || ' ' || {_listed(_SECOND)}[event_id // 7 % {len(_SECOND)} + 1] AS message, {_listed(_CODES)}[event_id // 3 % {len(_CODES)} + 1] AS code, CASE WHEN user_id % 4 <> 1 THEN {_listed(_STATUS)}[event_id // 5 % {len(_STATUS)} + 1] END AS status FROM events),
rl AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', {_listed(s)}::INT[], {_listed(c)}::VARCHAR[], {_listed(p)}::VARCHAR[], {_listed(w)}::VARCHAR[])" for i, (k, s, c, p, w) in enumerate(X.KINDS))}) v(i, kind, statuses, codes, parts, words)),
ac AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{a}', {r}, {f})" for k, (a, r, f) in X.ACTIONS.items())}) v(kind, action, retries, fatal)),
kd AS (SELECT event_id, min_by(kind, i) AS kind FROM lg JOIN rl ON list_contains(statuses, status) OR list_contains(codes, upper(code)) OR len(list_filter(parts, lambda p: contains(upper(code), p))) > 0 OR len(list_filter(words, lambda w: contains(lower(message), w))) > 0 GROUP BY event_id),
fk AS (SELECT event_id, coalesce(kind, 'UNKNOWN') AS kind FROM lg LEFT JOIN kd USING (event_id))"""


def named_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes with further names: English ones from type and tradition, Tibetan ones of turned words, spoken ones with i for e."""
    name = F.col("name")
    return kg_nodes(spark, folder).select(
        "id", "type", "name", "merge_status", F.when(F.col("verified"), F.array(F.initcap(F.split_part(name, F.lit(" "), F.lit(1))), F.concat(F.lit("the "), name))).alias("english"), F.array(F.concat_ws(" ", F.reverse(F.split(name, " ")))).alias("tibetan"), F.array(F.replace(name, F.lit("e"), F.lit("i"))).alias("phonetic"),
    )  # fmt: skip


NAMED_SQL = f"""{NODES_SQL}, nn AS (SELECT id, type, name, merge_status, CASE WHEN verified THEN [upper(split_part(name, ' ', 1)[1]) || lower(split_part(name, ' ', 1)[2:]), 'the ' || name] ELSE [] END AS english, [array_to_string(list_reverse(string_split(name, ' ')), ' ')] AS tibetan, [replace(name, 'e', 'i')] AS phonetic FROM kg_nodes)"""


def _search_sql(q: str, fuzzy: bool) -> str:
    low, hit = q.lower(), lambda c: f"len(list_filter({c}, lambda x: contains(lower(x), '{q.lower()}'))) > 0"
    fits = f"contains(lower(name), '{low}') OR {hit('english')} OR {hit('tibetan')} OR {hit('phonetic')}" if fuzzy else f"name = '{q}' OR list_contains(english, '{q}') OR list_contains(tibetan, '{q}') OR list_contains(phonetic, '{q}')"
    return f"""WITH {NAMED_SQL} SELECT id, type, name, CASE WHEN lower(name) = '{low}' THEN 1.0 WHEN contains(lower(name), '{low}') THEN 0.8 WHEN list_contains(list_transform(english, lambda x: lower(x)), '{low}') THEN 0.9 WHEN {hit("english")} THEN 0.7 ELSE 0.5 END::DOUBLE AS score,
CASE WHEN lower(name) = '{low}' THEN 'name' WHEN {hit("english")} THEN 'english' WHEN {hit("tibetan")} THEN 'tibetan' ELSE 'other' END AS field FROM nn WHERE merge_status = 'active' AND ({fits}) ORDER BY score DESC, name, id LIMIT 20"""


def travels(spark: SparkSession, folder: str) -> DataFrame:
    """The dated edges, and a visit of a place for each order, with its year; some visits have an end and a purpose, some no year."""
    o, i = table(spark, folder, "orders"), F.col("o_orderkey")
    year = F.year("o_orderdate").cast("long")
    visits = o.select(
        F.concat(F.lit("c"), "o_custkey").alias("src"), F.lit("visited").alias("predicate"), F.concat(F.lit("n"), i % 25).alias("dst"), (0.5 + i % 50 / 100.0).alias("confidence"),
        F.when(i % 7 != 0, year).alias("year"), F.when(i % 3 == 0, year - 1).alias("start_year"), F.when(i % 2 == 0, year + i % 5).alias("end_year"), F.when(i % 4 == 0, "pilgrimage").alias("purpose"),
    )  # fmt: skip
    return dated_edges(spark, folder).select("src", "predicate", "dst", "confidence", "year").unionByName(visits, allowMissingColumns=True)


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, native, ocr, pages, sure): documents as scans: their own text whole, cut short or blank, and a reading of some first
    part, with c for e, that failed for some."""
    d, i = table(spark, folder, "documents"), F.col("doc_id")
    native = F.when(i % 4 == 0, F.col("text")).when(i % 4 == 1, F.substr("text", F.lit(1), i % 300)).when(i % 4 == 2, "  ").otherwise(F.substring("text", 1, 40))
    return d.select("doc_id", native.alias("native"), F.when(i % 11 != 5, F.replace(F.substr("text", F.lit(1), i % 700 + 20), F.lit("e"), F.lit("c"))).alias("ocr"), F.when(i % 13 == 2, 0).otherwise(F.floor(F.char_length("text") / 500) + 1).alias("pages"), (i % 10 / 9.0).alias("sure"))


def dated_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(p_partkey, t): dates of parts told by cycle with and without element and animal."""
    k = F.col("p_partkey")
    n = k % 19 + 1
    suffix = F.when(n == 1, "st").when(n == 2, "nd").when(n == 3, "rd").otherwise("th")
    sign = F.concat_ws(" ", _pick(D.ELEMENTS, F.floor(k / 4)), _pick(D.ANIMALS, k))
    return table(spark, folder, "part").select("p_partkey", F.concat(F.when(k % 3 != 2, F.concat(F.lit("the "), sign, F.lit(" year of the "))).otherwise(F.lit("in the ")), n, suffix, F.lit(" Rabjung")).alias("t"))


QUERIES = {
    "sf6_line_artifacts": (lambda s, d: A.line_artifacts(paged(s, d)), f"WITH {PAGED_SQL} SELECT doc_id, line, n, kind, confidence FROM ar"),
    "sf6_without_artifacts": (lambda s, d: A.without_artifacts(paged(s, d)).select("doc_id", F.sha2("text", 256).alias("sha"), F.char_length("text").alias("length"), "dropped"), f"WITH {PAGED_SQL} SELECT doc_id, sha256(text) AS sha, length(text) AS length, dropped FROM cl"),
    "sx12_error_kinds": (
        lambda s, d: error_log(s, d).select("event_id", X.error_kind(F.col("message"), F.col("code"), F.col("status")).alias("kind")).select("event_id", "kind", X.recovery(F.col("kind")).alias("r")).select("event_id", "kind", "r.action", "r.retries", "r.retryable", "r.fatal"),
        f"WITH {LOG_SQL} SELECT event_id, kind, action, retries, retries > 0 AS retryable, fatal FROM fk JOIN ac USING (kind)",
    ),
    "gr17_search_names": (lambda s, d: G.search_names(named_nodes(s, d), "Bolt"), _search_sql("Bolt", True)),
    "gr17_search_spoken": (lambda s, d: G.search_names(named_nodes(s, d), "rid widgit", fuzzy=False), _search_sql("rid widgit", False)),
    "gr17_search_turned": (lambda s, d: G.search_names(named_nodes(s, d), "Widget Red"), _search_sql("Widget Red", True)),
    "ag18_report_with_corrections": (
        lambda s, d: Z.weekly_report(review_queue(s, d), table(s, d, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("created"), F.concat("l_returnflag", "l_linestatus").alias("kind"))),
        f"""WITH {REVIEW_SQL}, m AS (SELECT year(created) || '-W' || strftime(created, '%V') AS week, count(*) AS n, count(reviewed) AS reviewed, round(avg((epoch_us(reviewed) - epoch_us(created)) / 6e7), 6) AS turnaround, coalesce(round(count(*) FILTER (status = 'approved') / nullif(count(reviewed), 0), 6), 0.0) AS approval, coalesce(round(count(*) FILTER (status = 'rejected') / nullif(count(reviewed), 0), 6), 0.0) AS rejection FROM rq GROUP BY 1),
c AS (SELECT year(l_shipdate) || '-W' || strftime(l_shipdate, '%V') AS week, l_returnflag || l_linestatus AS kind, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT week, sum(n)::BIGINT AS corrections, string_agg(kind || ':' || n, ',' ORDER BY kind) AS by_kind FROM c GROUP BY week)
SELECT week, coalesce(n, 0) AS n, coalesce(reviewed, 0) AS reviewed, turnaround, coalesce(approval, 0) AS approval, coalesce(rejection, 0) AS rejection, coalesce(corrections, 0) AS corrections, coalesce(by_kind, '') AS by_kind FROM m FULL JOIN x USING (week)""",
    ),
    "src9_chosen_source": (
        lambda s, d: scans(s, d).select("doc_id", K.chosen_source(F.col("native"), F.col("ocr"), F.col("pages"), F.col("sure"), LATIN, acceptable=0.3).alias("c")).select("doc_id", "c.method", F.sha2("c.text", 256).alias("sha"), F.round("c.quality", 6).alias("quality")),
        rf"""WITH v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text[1:doc_id % 300] WHEN 2 THEN '  ' ELSE text[1:40] END AS native, CASE WHEN doc_id % 11 <> 5 THEN replace(text[1:doc_id % 700 + 20], 'e', 'c') END AS ocr, CASE WHEN doc_id % 13 = 2 THEN 0 ELSE length(text) // 500 + 1 END AS pages, doc_id % 10 / 9.0::DOUBLE AS sure FROM documents),
q AS (SELECT *, length(trim(native, E' 	

')) AS a, length(trim(ocr, E' 	

')) AS b, least(1, greatest(0, 0.4::DOUBLE * CASE WHEN regexp_replace(ocr, '[ 	

]', '', 'g') = '' THEN 0 ELSE len(regexp_extract_all(ocr, '{LATIN}')) / length(regexp_replace(ocr, '[ 	

]', '', 'g')) END + 0.5::DOUBLE * sure
  - 0.1::DOUBLE * (regexp_matches(ocr, '[0-9]{{10,}}')::INT + regexp_matches(ocr, '[^0-9A-Za-z_	

 ]{{5,}}')::INT + regexp_matches(ocr, '[A-Z]{{8,}}')::INT))) AS quality FROM v),
m AS (SELECT *, CASE WHEN pages = 0 OR a >= 50 * pages OR ocr IS NULL THEN 'native' WHEN quality < 0.3::DOUBLE AND a > 0 THEN 'hybrid' ELSE 'ocr' END AS method FROM q)
SELECT doc_id, method, sha256(CASE method WHEN 'native' THEN native WHEN 'ocr' THEN ocr ELSE CASE WHEN a < 100 THEN ocr WHEN b < 100 THEN native ELSE native || E'

[OCR-Enhanced Content]

' || ocr END END) AS sha, CASE WHEN method <> 'native' THEN round(quality, 6) END AS quality FROM m""",
    ),
    "gr13_journeys": (
        lambda s, d: G.journeys(kg_nodes(s, d), travels(s, d)),
        f"""WITH {DATED_SQL}, tv AS (SELECT src, predicate, dst, confidence, year, NULL::BIGINT AS end_year, NULL::VARCHAR AS purpose FROM dated
  UNION ALL SELECT 'c' || o_custkey, 'visited', 'n' || o_orderkey % 25, 0.5 + o_orderkey % 50 / 100.0::DOUBLE, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) - 1 WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) + o_orderkey % 5 END, CASE WHEN o_orderkey % 4 = 0 THEN 'pilgrimage' END FROM orders),
j AS (SELECT e.src AS person, n.id AS place, n.name, e.year, e.end_year, coalesce(e.purpose, e.predicate) AS purpose, round(coalesce(e.confidence, 0.5), 6) AS confidence FROM tv e JOIN kg_nodes p ON p.id = e.src AND p.type = 'person' JOIN kg_nodes n ON n.id = e.dst AND n.type = 'place' WHERE e.predicate IN ('lived_at', 'studied_at', 'taught_at', 'visited'))
SELECT person, row_number() OVER (PARTITION BY person ORDER BY coalesce(year, 9999), place, purpose, coalesce(end_year, 9999), confidence)::INT AS stop, place, name, year::BIGINT AS year, end_year::BIGINT AS end_year, purpose, confidence FROM j""",
    ),
    "tr2_named_cycles": (
        lambda s, d: dated_texts(s, d).select("p_partkey", D.resolve_date(F.col("t")).alias("r")).select("p_partkey", "r.year", "r.rule", "r.confidence"),
        f"""WITH sg AS (SELECT {_listed(D.ELEMENTS)}[i // 4 % 5 + 1] || ' ' || {_listed(D.ANIMALS)}[i % 12 + 1] AS sign, min(i) AS i FROM range(60) r(i) GROUP BY sign),
t AS (SELECT p_partkey, p_partkey % 19 + 1 AS n, CASE WHEN p_partkey % 3 <> 2 THEN {_listed(D.ELEMENTS)}[p_partkey // 4 % 5 + 1] || ' ' || {_listed(D.ANIMALS)}[p_partkey % 12 + 1] END AS sign FROM part),
j AS (SELECT p_partkey, n, i, 1027 + (n - 1) * 60 AS first FROM t LEFT JOIN sg USING (sign))
SELECT p_partkey, CASE WHEN n <= 17 THEN coalesce(first + i, first + 29) WHEN i IS NOT NULL THEN 1027 + i + (1499 - 1027 - i) // 60 * 60 END AS year, CASE WHEN n <= 17 THEN 'cycle' WHEN i IS NOT NULL THEN 'element-animal' END AS rule, CASE WHEN n <= 17 THEN CASE WHEN i IS NULL THEN 0.5 ELSE 0.9 END WHEN i IS NOT NULL THEN 0.6 END::DOUBLE AS confidence FROM j""",
    ),
}
