"""The corpus pipeline: toxic documents go, repeated lines go, near duplicates go, leaked benchmarks go, the rest is tokenised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontam, line_dedup, neardup, toxicity
from lodestone.llm.common import saved, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a toxic grade is under the operator's rejection level; all columns."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has; n_chars counts what is left."""
    return line_dedup.dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by similarity 0.75 over 5-word shingles."""
    return neardup.drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (three quarters of its 5-word shingles)."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and hashes: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    import public_tokenizers  # only this stage needs the vocabulary files

    return bpe.bpe_report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near), ("decontamination", leaks), ("bpe", tokens)]

#: The first stage's model and the token ids can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows in a Parquet table that the next reads.

    Documents with a null or empty text, or whose lines all went, stay to the end and have no tokens: no stage finds them
    toxic, alike or leaked. Rows with a null id stay; rows that share an id stay or go together where near duplicates go.
    Repeated rows lose no lines to each other. Without documents there are no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
