"""Headers, footers, watermarks and page numbers of texts: lines that repeat, their kind and how sure it is, and texts without them.

Lines are counted by document and line, so a line that all documents have is many keys. To take lines out, a document's lines
come together again by document: as much as its text, which is one value of a row anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\x0b\f\r"
#: Stands for a line that is taken out until the text is joined; a line of this alone is taken out too.
GONE = "\ue000"
PAGE_NUMBER = r"(?i)^(\d+|page\s+\d+|\d+\s+of\s+\d+)$"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_kind(line: Column) -> Column:
    """page-number, footer, watermark, header (under 50 characters) or unknown, of a trimmed line."""
    return (
        F.when(line.rlike(r"(?i)^(\d+|page \d+|\d+ of \d+)$"), "page-number").when(line.rlike("(?iu)copyright|©|all rights reserved"), "footer")
        .when(line.rlike("(?i)draft|confidential|proprietary"), "watermark").when(F.char_length(line) < 50, "header").otherwise("unknown")
    )


def line_confidence(line: Column, n: Column, lines: Column) -> Column:
    """Ten times the line's share of all lines up to .5; .2 under 30 characters; .3 for words of pages; .4 each for a bare number, a
    watermark's words, and words of rights or "n of m"; at most 1."""
    has = lambda pattern, by: F.when(line.rlike(pattern), by).otherwise(0.0)
    out = F.least(n * 10 / lines, F.lit(0.5)) + F.when(F.char_length(line) < 30, 0.2).otherwise(0.0) + has("(?i)page|copyright|draft|header|footer", 0.3)
    return F.round(F.least(out + has(r"^\d+$", 0.4) + has("(?i)DRAFT|CONFIDENTIAL|PROPRIETARY", 0.4) + has(r"(?i)copyright|©|\d+ of \d+", 0.4), F.lit(1.0)), 9)


def _lines(docs: DataFrame) -> DataFrame:
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    return docs.select("doc_id", F.size(parts).alias("lines"), F.posexplode(parts).alias("pos", "line")).withColumn("own", _trimmed(F.col("line")))


def line_artifacts(docs: DataFrame, at_least: int = 3, longest: int = 100) -> DataFrame:
    """(doc_id, line, n, kind, confidence): trimmed lines of at most `longest` characters that stand at_least times in a document.

    Lines end at \\n. Blank lines don't count; null texts have none. A doc_id stands once.
    """
    counted = _lines(docs).where((F.col("own") != "") & (F.char_length("own") <= longest)).groupBy("doc_id", "own").agg(F.count(F.lit(1)).alias("n"), F.max("lines").alias("lines")).where(F.col("n") >= at_least)
    return counted.select("doc_id", F.col("own").alias("line"), "n", line_kind(F.col("own")).alias("kind"), line_confidence(F.col("own"), F.col("n"), F.col("lines")).alias("confidence"))


def without_artifacts(docs: DataFrame, sure: float = 0.7) -> DataFrame:
    """(doc_id, text, dropped): texts without the lines (whatever their case) that line_artifacts is surer of than `sure`, and without
    page numbers; dropped counts lines.

    A run of such lines, blank ones around them included, becomes one empty line; more than one empty line in a row becomes one;
    blanks at ends of lines and of the text go. Null and blank texts are empty. A doc_id stands once.
    """
    bad = line_artifacts(docs).where(F.col("confidence") > sure).select("doc_id", F.lower("line").alias("low")).distinct().withColumn("bad", F.lit(True))
    each = _lines(docs).withColumn("low", F.lower("own")).join(bad, ["doc_id", "low"], "left")
    gone = F.coalesce("bad", F.lit(False)) | F.col("own").rlike(PAGE_NUMBER)
    by = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(gone, GONE).otherwise(F.col("line")).alias("line")))).alias("l"), F.count_if(gone).alias("dropped"))
    text = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, rf"(?md)^\s*{GONE}[\s{GONE}]*$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?<![^\S\n])[^\S\n]++(?=\n|\z)", "")
    return by.select("doc_id", F.btrim(text, F.lit(BLANKS + "\n")).alias("text"), "dropped")
