"""Text measures and clean-up, as column expressions. Script classes are parameters: regular-expression classes of characters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyspark.sql.types as S
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Characters that are in normal form C wherever they stand: Latin, Cyrillic, dashes and quotes, common Chinese.
INERT = r"\x{0000}-\x{02FF}\x{0400}-\x{0482}\x{2010}-\x{2027}\x{4E00}-\x{9FFF}"
TIBETAN = r"[\x{0F00}-\x{0FFF}]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def token_estimate(text: Column, script: str = TIBETAN) -> Column:
    """A quarter of the script's characters and 1.3 times the other words, both rounded up."""
    t = _text(text)
    own = F.regexp_count(t, F.lit(script))
    rest = F.regexp_count(F.regexp_replace(t, script, " "), F.lit(r"\S+"))
    return (F.ceil(own / 4.0) + F.ceil(rest * F.lit(1.3))).cast("long")


def class_counts(text: Column, classes: dict[str, str]) -> list[Column]:
    return [F.regexp_count(_text(text), F.lit(pattern)).cast("long").alias(name) for name, pattern in classes.items()]


def unicode_flags(text: Column) -> dict[str, Column]:
    """Problems of a text's characters: replacement characters, nulls, controls, zero-width characters, broken encodings."""
    t = _text(text)
    rules = {"replacement": r"\x{FFFD}", "null": r"\x{0000}", "control": r"[\x{0001}-\x{0008}\x{000E}-\x{001F}\x{007F}]", "zero_width": r"[\x{200B}-\x{200D}\x{FEFF}]", "mojibake": r"Ã[\x{0080}-\x{00BF}]|â€"}
    return {k: t.rlike(p) for k, p in rules.items()}


@pandas_udf(S.StructType([S.StructField("composed", S.BooleanType()), S.StructField("mixed", S.BooleanType()), S.StructField("text", S.StringType())]))
def _normal(texts: pd.Series) -> pd.DataFrame:
    known: dict[str, str] = {}

    def composed(m: re.Match) -> str:
        run = m[0]
        if run not in known:
            known[run] = unicodedata.normalize("NFC", run)
        return known[run]

    rows = []
    for t in texts:
        if t is None:
            rows.append((None, None, None))
            continue
        out = re.sub(r".?[^\x00-\x7f]+", composed, t, flags=re.S)  # a mark may join the plain letter before it
        marked = re.search(r"[\u0300-\u036f]", t) is not None
        rows.append((out == t, marked and re.search(r"[\u00c0-\u024f\u1e00-\u1eff]", t) is not None, out))
    return pd.DataFrame(rows, columns=["composed", "mixed", "text"])


def normal_form(text: Column) -> Column:
    """Struct (composed, mixed, text): whether a text is in normal form C; whether it has both composed letters and marks of their own;
    the text in that form. Only runs of non-ASCII characters are worked on, each different one once a batch. A null text is an empty one.
    Texts of characters that never join others (INERT) are as they are and don't go to Python.
    """
    t = _text(text)
    plain = ~t.rlike(f"[^{INERT}]")
    worked = _normal(F.when(~plain, t))
    return F.struct(F.when(plain, True).otherwise(worked["composed"]).alias("composed"), F.when(plain, False).otherwise(worked["mixed"]).alias("mixed"), F.when(plain, t).otherwise(worked["text"]).alias("text"))


def strip_html(html: Column) -> Column:
    out = F.regexp_replace(_text(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def suspicious(text: Column) -> Column:
    return F.lower(_text(text)).rlike(r"<script|javascript:|onerror\s*=|\bunion\s+select\b")


def repeated_lines(docs: DataFrame, at_least: int = 3, longest: int = 100) -> DataFrame:
    """(doc_id, line, n): trimmed lines that stand at_least times in one document: headers, footers, watermarks.

    The count is by document and line, so that a line in many documents is spread over all of them.
    """
    lines = docs.select("doc_id", F.explode(F.split(_text(F.col("text")), "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    return lines.where((F.col("line") != "") & (F.char_length("line") <= longest)).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def hash_duplicates(docs: DataFrame) -> DataFrame:
    """(hash, first_id, n) of texts that stand more than once."""
    return docs.groupBy(F.sha2(_text(F.col("text")).cast("binary"), 256).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def bracket_terms(text: Column) -> Column:
    """Array of what stands in round brackets, trimmed."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda s: F.trim(s))


def frequency_class(n: Column) -> Column:
    return F.when(n >= 20, "very_common").when(n >= 10, "common").when(n >= 3, "uncommon").otherwise("rare")


def repair_json(text: Column) -> Column:
    """Text of a model's answer as JSON: without fences, from the first to the last brace, without trailing commas."""
    out = F.regexp_replace(_text(text), r"```(?:json)?", "")
    out = F.regexp_extract(out, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(out, r",(\s*[}\]])", "$1")


def error_class(message: Column) -> Column:
    m = F.lower(_text(message))
    return F.when(m.rlike("rate limit|429|quota"), "rate_limit").when(m.rlike("timeout|timed out"), "timeout").when(m.rlike("network|econn|socket"), "network").when(m.rlike("parse|json|syntax"), "parse").when(m.rlike("auth|401|403"), "auth").otherwise("unknown")
