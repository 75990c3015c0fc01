"""Queries over the text checks, with their SQL. Accented Latin letters stand for the source's script."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import checks as C
from lodestone.session import table
from lodestone.sources.views import METRICS_SQL, translation_metrics

LATIN = r"[\x{00C0}-\x{00FF}]"
WORD = r"[^་༌།༎\t\n\f\r\x0B ]+"
SPACE = r"[\t\n\f\r\x0B ]"


def _docs(f):
    return lambda spark, folder: f(table(spark, folder, "documents"))


def _turns(f):
    """f over conversations as pairs: each turn is the output for the turn before it."""

    def query(spark, folder):
        t = table(spark, folder, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("output"))
        before = F.lag("output").over(Window.partitionBy("conv_id").orderBy("turn", "output"))
        given = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("Sure, here it is:\n"), "output")).when(F.col("conv_id") % 5 == 1, F.concat(F.lit("```\n"), "output", F.lit("\n```"))).when(F.col("conv_id") % 5 == 2, F.concat(F.lit("**Note** ("), "output")).otherwise(F.concat("output", F.lit(" one (é "), "turn", F.lit("). two ( ) here")))
        return f(t.select("conv_id", "turn", before.alias("source"), given.alias("output")))

    return query


PAIRS = """pairs AS (SELECT conv_id, turn, lag(o) OVER (PARTITION BY conv_id ORDER BY turn, o) AS source, CASE conv_id % 5 WHEN 0 THEN 'Sure, here it is:' || chr(10) || o WHEN 1 THEN '```' || chr(10) || o || chr(10) || '```' WHEN 2 THEN '**Note** (' || o ELSE o || ' one (é ' || turn || '). two ( ) here' END AS output
  FROM (SELECT conv_id, turn, coalesce(text, '') AS o FROM conversations))"""
META = C.META.replace("'", "''")
REFUSALS = C.REFUSALS.replace("'", "''")
FORMAT = {
    "meta_text": f"regexp_matches(o, '{META}')", "code_block": "contains(o, '```')", "markdown": r"regexp_matches(o, '(?m)^#{1,6} |\*\*[^*]+\*\*|^[-*] ')", "nested_brackets": r"regexp_matches(o, '\([^()]*\(')",
    "unbalanced_brackets": r"len(regexp_extract_all(o, '\(')) <> len(regexp_extract_all(o, '\)'))", "empty_brackets": rf"regexp_matches(o, '\({SPACE}*\)')",
}
OUTPUT = {
    "empty": "trim(o) = ''", "too_short": "trim(o) <> '' AND length(o) / greatest(length(s), 1) < 0.3", "too_long": "length(o) / greatest(length(s), 1) > 5", "refusal": f"regexp_matches(o, '{REFUSALS}')", "unbalanced_brackets": FORMAT["unbalanced_brackets"],
    "script_outside_brackets": rf"regexp_matches(regexp_replace(o, '\([^()]*\)', '', 'g'), '{LATIN}')", "script_lost": f"regexp_matches(s, '{LATIN}') AND NOT regexp_matches(o, '{LATIN}')", "unfinished": r"""trim(o) <> '' AND NOT regexp_matches(rtrim(o), '[.!?)"''’”]\z')""",
}
_list = lambda rules: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules.items()) + "], lambda x: x IS NOT NULL)"
OF = f"WITH {PAIRS}, p AS (SELECT conv_id, turn, coalesce(source, '') AS s, coalesce(output, '') AS o FROM pairs)"
IN_BRACKETS = rf"\([^)]*{LATIN}[^)]*\)"
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[|¦]', '།', 'g'), '།[\t\n\f\r\x0B ]+།', '།།', 'g'), '[~^`_\\]', '', 'g'), '[ \t]{2,}', ' ', 'g'))"
SPACED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g'), '([,;:!?])([A-Za-z])', '\1 \2', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\( +', '(', 'g'), ' +\)', ')', 'g'))"
TOKENS = lambda t: rf"(ceil(len(regexp_extract_all({t}, '{LATIN}')) / 4.0) + ceil(len(regexp_extract_all(regexp_replace({t}, '{LATIN}', ' ', 'g'), '[^\t\n\f\r\x0B ]+')) * 1.3::DOUBLE))"
HEADED = "SELECT conv_id AS doc_id, turn::BIGINT AS page, 'Report ' || conv_id || chr(10) || coalesce(text, '') || chr(10) || 'page ' || turn AS text FROM conversations"


def _headed(spark, folder):
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("page"), F.concat(F.lit("Report "), "conv_id", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\npage "), "turn").alias("text"))


def _paged(spark, folder):
    c = table(spark, folder, "conversations").where("text is not null")
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("Page "), "turn", F.lit(":\n"), "text").alias("t"))))
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


GIVEN = ("great master", "white monastery", "fire offering", "empty view", "root tantra", "red widget")
TM = f"WITH {METRICS_SQL}"

QUERIES = {
    "sf2_fitting_prefix": (
        _docs(lambda d: d.select("doc_id", F.char_length(C.fitting_prefix(F.col("text"), 40, LATIN)).cast("long").alias("chars"))),
        f"""WITH w AS (SELECT doc_id, string_split_regex(trim(text), '{SPACE}+') AS w FROM documents), p AS (SELECT doc_id, array_to_string(w[1:n], ' ') AS t FROM (SELECT *, unnest(range(0, least(len(w), 260) + 1)) AS n FROM w))
SELECT doc_id, max(length(t)) AS chars FROM p WHERE {TOKENS('t')} <= 40 GROUP BY doc_id""",
    ),
    "sf5_pages": (
        lambda s, d: C.pages(_paged(s, d)).select("doc_id", "page", F.sha2("text", 256).alias("sha")),
        "SELECT conv_id AS doc_id, turn::BIGINT AS page, sha256(trim(ltrim(text, ' ' || chr(10)))) AS sha FROM conversations WHERE trim(ltrim(text, ' ' || chr(10))) <> ''",
    ),
    "sf7_page_artifacts": (
        lambda s, d: C.page_artifacts(_headed(s, d)),
        rf"""WITH h AS ({HEADED}), l AS (SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '[0-9]+', '#', 'g')), lambda x: x <> '') AS l FROM h),
b AS (SELECT DISTINCT doc_id, page, 'header' AS place, unnest(l[1:3]) AS line FROM l UNION SELECT DISTINCT doc_id, page, 'footer', unnest(list_reverse(l)[1:3]) FROM l), t AS (SELECT doc_id, count(DISTINCT page) AS a FROM h GROUP BY doc_id HAVING count(DISTINCT page) >= 3)
SELECT doc_id, place, line, count(*) AS pages, round(count(*) / any_value(a), 6) AS confidence FROM b JOIN t USING (doc_id) GROUP BY doc_id, place, line HAVING count(*) / any_value(a) >= 0.5""",
    ),
    "sf10_syllables": (
        _docs(lambda d: d.select("doc_id", F.size(C.syllables(F.col("text"))).cast("long").alias("n"), F.round(C.script_ratio(F.col("text"), LATIN), 6).alias("ratio"))),
        rf"SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS n, round(CASE WHEN regexp_replace(text, '{SPACE}', '', 'g') = '' THEN 0 ELSE len(regexp_extract_all(text, '{LATIN}')) / length(regexp_replace(text, '{SPACE}', '', 'g')) END, 6) AS ratio FROM documents",
    ),
    "sf12_entropy": (
        _docs(C.character_entropy),
        "WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents), k AS (SELECT doc_id, c, count(*) AS k FROM c GROUP BY ALL) SELECT doc_id, sum(k)::BIGINT AS n, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS entropy FROM k GROUP BY doc_id",
    ),
    "sf13_ocr_clean": (_docs(lambda d: d.select("doc_id", F.sha2(C.ocr_clean(F.col("text")), 256).alias("sha"))), f"SELECT doc_id, sha256({CLEAN}) AS sha FROM documents"),
    "sf14_ocr_quality": (
        _docs(lambda d: d.select("doc_id", F.round(C.ocr_quality(F.col("text"), F.col("doc_id") % 100 / 100.0, LATIN), 6).alias("quality"))),
        rf"""WITH r AS (SELECT doc_id, text, CASE WHEN regexp_replace(text, '{SPACE}', '', 'g') = '' THEN 0 ELSE len(regexp_extract_all(text, '{LATIN}')) / length(regexp_replace(text, '{SPACE}', '', 'g')) END AS ratio FROM documents)
SELECT doc_id, round(least(1, greatest(0, 0.4::DOUBLE * ratio + 0.5::DOUBLE * (doc_id % 100 / 100.0::DOUBLE) - 0.1::DOUBLE * (regexp_matches(text, '[0-9]{{10,}}')::INT + regexp_matches(text, '[^0-9A-Za-z_\t\n\f\r\x0B ]{{5,}}')::INT + regexp_matches(text, '[A-Z]{{8,}}')::INT))), 6) AS quality FROM r""",
    ),
    "sf15_term_pairs": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.explode(C.term_pairs(F.concat(F.lit("They call it "), "p_name", F.lit(" (é"), F.lower("p_type"), F.lit(") and ("), "p_brand", F.lit(") here")), LATIN)).alias("t")).select("p_partkey", "t.*"),
        "SELECT p_partkey, 'call it ' || p_name AS english, 'é' || lower(p_type) AS term FROM part",
    ),
    "sf17_categories": (
        lambda s, d: table(s, d, "part").select("p_partkey", C.term_category(F.element_at(F.array(*map(F.lit, GIVEN)), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_name")).alias("category")),
        "SELECT p_partkey, ['person', 'place', 'ritual', 'philosophy', 'text', 'general'][p_partkey % 6 + 1] AS category FROM part",
    ),
    "sf19_format_issues": (_turns(lambda p: p.select("conv_id", "turn", F.array_join(C.format_issues(F.col("output")), ",").alias("issues"))), f"{OF} SELECT conv_id, turn, array_to_string({_list(FORMAT)}, ',') AS issues FROM p"),
    "sf19_format_corrected": (
        _turns(lambda p: p.select("conv_id", "turn", F.sha2(C.format_corrected(F.col("output")), 256).alias("sha"))),
        rf"{OF} SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(o, '{META}', '', 'g'), '```[a-z]*\n?', '', 'g'), '(?m)^#{{1,6}} +', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), ' *\({SPACE}*\)', '', 'g'), '[ \t]{{2,}}', ' ', 'g'))) AS sha FROM p",
    ),
    "sf20_output_issues": (_turns(lambda p: p.select("conv_id", "turn", F.array_join(C.output_issues(F.col("source"), F.col("output"), LATIN), ",").alias("issues"))), f"{OF} SELECT conv_id, turn, array_to_string({_list(OUTPUT)}, ',') AS issues FROM p"),
    "sf21_validated": (
        _turns(lambda p: C.validated(p, LATIN).select("conv_id", "turn", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"), "valid")),
        f"{OF}, v AS (SELECT conv_id, turn, list_distinct(list_concat({_list(OUTPUT)}, {_list(FORMAT)})) AS v FROM p), f AS (SELECT *, len(list_filter(v, lambda x: x IN ('empty', 'refusal', 'unbalanced_brackets')))::INT AS errors FROM v) SELECT conv_id, turn, errors, len(v)::INT - errors AS warnings, errors = 0 AS valid FROM f",
    ),
    "sf22_spaced": (_docs(lambda d: d.select("doc_id", F.sha2(C.spaced(F.col("text")), 256).alias("sha"))), f"SELECT doc_id, sha256({SPACED}) AS sha FROM documents"),
    "sf25_keywords": (
        _turns(lambda p: p.select("conv_id", "turn", C.keywords(F.col("source"), LATIN, ("é", "è")).alias("a"), C.keywords(F.col("output"), LATIN, ("é", "è")).alias("b")).select("conv_id", "turn", F.size("b").cast("long").alias("n"), F.round(C.keyword_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))),
        rf"""{OF}, k AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(s, '{WORD}'), lambda w: regexp_matches(w, '{LATIN}') AND w NOT IN ('é', 'è'))) AS a, list_distinct(list_filter(regexp_extract_all(o, '{WORD}'), lambda w: regexp_matches(w, '{LATIN}') AND w NOT IN ('é', 'è'))) AS b FROM p)
SELECT conv_id, turn, len(b) AS n, round(CASE WHEN greatest(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / greatest(len(a), len(b)) ELSE 0 END, 6) AS overlap FROM k""",
    ),
    "sx3_keyword_tokens": (_docs(lambda d: d.select("doc_id", F.size(C.keywords(F.col("text"), LATIN, ())).cast("long").alias("n"))), rf"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '{WORD}'), lambda w: regexp_matches(w, '{LATIN}')))) AS n FROM documents"),
    "sx6_ocr_needed": (
        lambda s, d: C.ocr_needed(table(s, d, "conversations").select("conv_id", F.when(F.col("turn") % 3 == 1, 0).otherwise(F.char_length("text") % 90).alias("chars"), (F.col("turn") % 2).alias("images")), ["conv_id"]),
        """WITH p AS (SELECT conv_id, count(*) AS pages, sum(c)::BIGINT AS chars, avg((c < 50)::INT) AS share, max(i) AS images FROM (SELECT conv_id, CASE WHEN turn % 3 = 1 THEN 0 ELSE length(text) % 90 END AS c, turn % 2 AS i FROM conversations) GROUP BY conv_id),
r AS (SELECT *, CASE WHEN chars = 0 THEN 1 WHEN chars / pages < 50 THEN 2 WHEN share >= 0.3 THEN 3 WHEN images > 0 AND share > 0.1 THEN 4 ELSE 5 END AS k FROM p)
SELECT conv_id, pages, chars, k < 5 AS needed, round([1.0, 0.9, least(0.8, share), 0.7, 0.0][k]::DOUBLE, 6) AS confidence, ['no text', 'little text', 'sparse pages', 'images', 'enough text'][k] AS reason FROM r""",
    ),
    "sx7_fallback_pieces": (
        _docs(lambda d: d.select("doc_id", C.fallback_pieces(F.col("text")).alias("p")).select("doc_id", F.char_length(F.col("p")[0]).alias("first"), F.char_length(F.col("p")[1]).alias("second"))),
        r"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\n\n+'), lambda x: trim(x)), lambda x: length(x) >= 20)[1:2] AS a, list_filter(list_transform(string_split(text, '།'), lambda x: trim(x)), lambda x: length(x) >= 20)[1:2] AS b, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 40)[1:2] AS c FROM documents),
q AS (SELECT doc_id, CASE WHEN len(a) = 2 THEN a WHEN len(b) = 2 THEN b WHEN len(c) = 2 THEN c ELSE [text[1:length(text) // 2], text[length(text) // 2 + 1:]] END AS p FROM p) SELECT doc_id, length(p[1])::INT AS first, length(p[2])::INT AS second FROM q""",
    ),
    "sx8_refinement": (
        _turns(lambda p: p.select("conv_id", "turn", F.round(C.refinement_confidence(F.col("output"), F.col("source"), LATIN), 6).alias("confidence"))),
        rf"""{OF}, x AS (SELECT *, len(regexp_extract_all(o, '{IN_BRACKETS}')) AS b, list_filter(string_split_regex(o, '[.!?]+'), lambda v: trim(v) <> '') AS st, length(regexp_replace(o, '\([^)]*\)', '', 'g')) / greatest(length(s), 1) AS r FROM p)
SELECT conv_id, turn, round(least(0.95, greatest(0.2, 0.7 + least(0.2, 0.04::DOUBLE * b) + CASE WHEN len(st) > 0 THEN 0.2::DOUBLE * len(list_filter(st, lambda v: regexp_matches(v, '{IN_BRACKETS}'))) / len(st) ELSE 0 END + CASE WHEN r BETWEEN 0.7 AND 2.5 AND s <> '' THEN 0.15 ELSE 0 END + CASE WHEN contains(o, 'Error:') OR contains(o, 'Failed:') THEN 0 ELSE 0.05 END))::DOUBLE, 6) AS confidence FROM x""",
    ),
    "sx18_helper_confidence": (
        _turns(lambda p: p.select("conv_id", "turn", F.round(C.helper_confidence(F.col("output"), 0.75, LATIN), 6).alias("confidence"))),
        rf"{OF}, x AS (SELECT *, len(string_split_regex(o, '{SPACE}+')) AS n FROM p) SELECT conv_id, turn, round(least(0.95, greatest(0.1, 0.75 + 0.02::DOUBLE * len(regexp_extract_all(o, '{IN_BRACKETS}')) + CASE WHEN regexp_matches(o, '[.!?]{SPACE}*\([^)]*\)') THEN 0.05 ELSE 0 END - CASE WHEN n < 5 THEN 0.1 WHEN n > 500 THEN 0.05 ELSE 0 END))::DOUBLE, 6) AS confidence FROM x",
    ),
    "sx9_weighted_gates": (
        lambda s, d: translation_metrics(s, d).select("event_id", C.weighted_gates({"confidence": F.col("confidence"), "format": F.col("k") / 100.0, "length": C.length_gate(F.col("k") / 12.0), "preservation": F.when(F.col("k") % 5 == 0, 0.6).otherwise(0.95), "agreement": F.when(F.col("k") % 7 > 0, F.col("k") / 100.0)}).alias("g")).select("event_id", "g.score", F.array_join("g.failed", ",").alias("failed")),
        f"""{TM}, g AS (SELECT event_id, confidence AS a, k / 100.0::DOUBLE AS b, CASE WHEN k / 12.0 BETWEEN 0.5 AND 3 THEN 1.0 WHEN k / 12.0 BETWEEN 0.3 AND 5 THEN 0.7 WHEN k / 12.0 BETWEEN 0.2 AND 8 THEN 0.4 ELSE 0.3 END::DOUBLE AS c, CASE WHEN k % 5 = 0 THEN 0.6 ELSE 0.95 END::DOUBLE AS p, CASE WHEN k % 7 > 0 THEN k / 100.0::DOUBLE END AS e FROM tm)
SELECT event_id, round((0.3::DOUBLE * a + 0.25::DOUBLE * b + 0.15::DOUBLE * c + 0.2::DOUBLE * p + 0.1::DOUBLE * coalesce(e, 0)) / CASE WHEN e IS NULL THEN 0.9 ELSE 1.0 END::DOUBLE, 6) AS score,
  array_to_string(list_filter([CASE WHEN a < 0.7 THEN 'confidence' END, CASE WHEN b < 0.7 THEN 'format' END, CASE WHEN c < 0.7 THEN 'length' END, CASE WHEN p < 0.7 THEN 'preservation' END, CASE WHEN e < 0.6 THEN 'agreement' END], lambda x: x IS NOT NULL), ',') AS failed FROM g""",
    ),
    "sx10_annotated_once": (
        lambda s, d: table(s, d, "part").select("p_partkey", C.annotated_once(F.concat("p_name", F.lit(" and "), "p_name"), F.substring_index("p_name", " ", -1), F.lower("p_type")).alias("text")),
        "SELECT p_partkey, p_name || ' (' || lower(p_type) || ') and ' || p_name AS text FROM part",
    ),
    "wn7_sentence_overlap": (
        lambda s, d: C.sentence_overlap(table(s, d, "conversations").select("conv_id", "turn", F.split("text", r"\. ").alias("s")), ["conv_id"], "turn", "s").select("conv_id", "turn", F.array_join("overlap", "|").alias("overlap")),
        "SELECT conv_id, turn, coalesce(array_to_string((lag(string_split(text, '. ')) OVER (PARTITION BY conv_id ORDER BY turn))[-2:], '|'), '') AS overlap FROM conversations",
    ),
    "ma3_agreement": (
        lambda s, d: C.pairwise_agreement(table(s, d, "conversations"), ["conv_id"], "text"),
        rf"""WITH w AS (SELECT conv_id, row_number() OVER () AS i, list_distinct(regexp_extract_all(lower(text), '[^\t\n\f\r\x0B ]+')) AS w FROM conversations), p AS (SELECT conv_id, avg(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))) AS m FROM w a JOIN w b USING (conv_id) WHERE a.i < b.i GROUP BY conv_id)
SELECT conv_id, n, round(coalesce(m, 1), 6) AS agreement FROM (SELECT conv_id, count(*) AS n FROM w GROUP BY conv_id) LEFT JOIN p USING (conv_id)""",
    ),
}
