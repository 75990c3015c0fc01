"""Exact line deduplication over a corpus, in DataFrame functions only.

Every line becomes a 128-bit hash of its key, its document and its position. The hashes are range-partitioned
and sorted by document and position inside each key, so that the first document of a key streams by first. What
comes back for each text is a compressed keep bitmap: the runs of lines to keep. Lines themselves are never shuffled;
whole texts move once, to meet their bitmaps.

A key that a large part of all documents shares is dealt over ``SALTS`` ranges by a hash of the document. A first
pass streams the first document of each (key, salt); a line of any other document is a copy whatever other
ranges hold. A second pass streams the at most ``SALTS`` remaining documents of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WHITESPACE, ascii_lower, partitions, put_back, saved, set_aside

SALTS = 64
#: Documents without an id come after all others.
LAST = 2**63 - 1


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for a row even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITESPACE)))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bitmaps (id, text_hash, dropped_lines, keep_runs) for the texts that lose lines; all others keep all.

    keep_runs: array of (start, len), the run-length form of the bitmap, without empty runs and without the run after
    the last dropped line (its length is 2147483647). A line goes if its key has min_chars code points or more and a
    document with a smaller id has that key too. Rows with the same id count as one document; repeated rows share a
    bitmap. A null id comes after all ids; a null text is one empty line; an empty table gives no rows.
    """
    n = partitions(docs)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_d"), F.col(text_col).alias("_t"))
    lines = src.select("_d", F.xxhash64("_t").alias("_h"), F.posexplode(lines_of(F.col("_t"))).alias("_pos", "_line"))
    keys = lines.withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    hashed = keys.select("_d", "_h", "_pos", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(7), "_key").alias("_k2"))
    hashed = saved(hashed.withColumn("_salt", F.pmod(F.hash("_d"), F.lit(SALTS))))  # ranges are drawn from it, then it is dealt

    def streamed(df: DataFrame, *key: str) -> DataFrame:
        dealt = df.repartitionByRange(n, *key).sortWithinPartitions(*key, "_d", "_h", "_pos")
        return dealt.withColumn("_first", F.first("_d").over(Window.partitionBy(*key).orderBy("_d", "_h", "_pos")))

    local = streamed(hashed, "_k1", "_k2", "_salt")
    # Copies within a (key, salt) are settled and keep their salt; the others meet under salt -1.
    local = local.withColumn("_copy", F.col("_d") > F.col("_first")).drop("_first")
    local = local.withColumn("_salt", F.when(F.col("_copy"), F.col("_salt")).otherwise(F.lit(-1)))
    whole = streamed(local, "_k1", "_k2", "_salt").where(F.col("_copy") | (F.col("_d") > F.col("_first")))
    per_doc = whole.groupBy("_d", "_h").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), "_gone"),
        F.concat(F.col("_gone"), F.array(F.lit(2**31 - 1))),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("len")),
    )
    return per_doc.select(
        F.col("_d").alias(id_col), F.col("_h").alias("text_hash"), F.size("_gone").cast("long").alias("dropped_lines"), F.filter(runs, lambda r: r["len"] > 0).alias("keep_runs")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _kept (the text of the lines kept; null texts stay null where nothing is dropped), _n_lines, _n_dropped."""
    marks = bitmaps.select(F.col(id_col).alias("_d"), F.col("text_hash").alias("_h"), F.col("dropped_lines").alias("_n_dropped"), F.col("keep_runs").alias("_runs"))
    keyed = docs.withColumns({"_d": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "_h": F.xxhash64(text_col)})
    both = keyed.join(marks.hint("shuffle_hash"), ["_d", "_h"], "left")
    kept = _let(lines_of(F.col(text_col)), lambda all_lines: F.array_join(F.flatten(F.transform(F.col("_runs"), lambda r: F.slice(all_lines, r["start"] + 1, r["len"]))), "\n"))
    out = both.withColumns({
        "_kept": F.when(F.col("_runs").isNull(), F.col(text_col)).otherwise(kept),
        "_n_lines": F.size(lines_of(F.col(text_col))).cast("long"),
        "_n_dropped": F.coalesce("_n_dropped", F.lit(0)).cast("long"),
    })
    return out.drop("_d", "_h", "_runs")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with the repeated lines taken out of text (and n_chars, where there is one, counted anew).

    All rows stay; a text whose lines all go becomes empty. Other columns pass through.
    """
    packed = set_aside(docs)
    out = apply_bitmaps(packed, keep_bitmaps(packed, min_chars))
    changed = {"text": F.col("_kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_n_dropped") > 0, F.char_length("_kept").cast("long")).otherwise(F.col("_rest")["n_chars"])
    return put_back(out, docs.columns, **changed)


def line_dedup_report(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row of docs."""
    few = docs.select("doc_id", "text")
    out = apply_bitmaps(few, keep_bitmaps(few, min_chars))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("_kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
