"""Dictionaries and glossaries in JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "tibetan string, english string, wylie string, category string, frequency string, context string, alternateTranslations array<string>, _bad string"


def load_dictionary(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad) entries: bad ones can't be parsed or have no term or no translation; a reason says which."""
    raw = spark.read.schema(ENTRY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", multi_line).json(path)
    reason = F.when(F.col("_bad").isNotNull(), "unparsed").when(F.coalesce(F.trim("tibetan"), F.lit("")) == "", "no term").when(F.coalesce(F.trim("english"), F.lit("")) == "", "no translation")
    checked = raw.withColumn("reason", reason)
    return checked.where("reason is null").drop("_bad", "reason"), checked.where("reason is not null")


def lookup(texts: DataFrame, dictionary: DataFrame, term: str = "tibetan", split: str = r"[\s།་]+") -> DataFrame:
    """(doc_id, term, english): words of the texts that are terms; one join on equality, not a search for each term."""
    words = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", split))).alias("term"))
    return words.join(dictionary.select(F.col(term).alias("term"), "english"), "term").select("doc_id", "term", "english")


def export_glossary(glossary: DataFrame, path: str) -> None:
    glossary.select(F.to_json(F.struct(*glossary.columns)).alias("value")).write.mode("overwrite").text(path)


def import_glossary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("v")).select("v.*")
