"""Translations beside their originals: which terms of a dictionary they render, and their grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import grading as G
from lodestone.functions.text import TIBETAN
from lodestone.operators.containment import contained


def dictionary_hits(pairs: DataFrame, dictionary: DataFrame, most: int = 20) -> DataFrame:
    """(key, terms, matched, used) for each of pairs (key, original, translation) that holds a term of dictionary (term, english, alternates).

    terms: how many terms stand in the original, of which the `most` longest count (ties by term); matched: those of which a
    rendering stands in the translation, whatever the case; used: those whose first rendering, or the term itself, does. Both
    texts meet the dictionary by containment, a block of terms at a time. Keys and terms come once each.
    """
    words = dictionary.where("term <> ''").select("term", F.lower("english").alias("english"), F.explode(F.array_distinct(F.transform(F.concat(F.array("english"), F.coalesce("alternates", F.array().cast("array<string>"))), lambda x: F.lower(x)))).alias("word"))
    here = contained(pairs, words, "key", "original", "term").withColumnRenamed("pattern", "term")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.char_length("term")), "term"))
    wanted = here.withColumn("i", place).where(F.col("i") <= most).select("key", "term")
    low = pairs.select("key", F.lower("translation").alias("translation"))
    there = contained(low, words, "key", "translation", "word").select("key", F.col("pattern").alias("word"), F.lit(True).alias("said"))
    kept = contained(pairs, words, "key", "translation", "term").select("key", F.col("pattern").alias("term"), F.lit(True).alias("kept"))
    each = wanted.join(words, "term").join(there, ["key", "word"], "left").join(kept, ["key", "term"], "left")
    said = F.coalesce("said", F.lit(False))
    by = each.groupBy("key", "term").agg(F.bool_or(said).alias("any"), F.bool_or((said & (F.col("word") == F.col("english"))) | F.coalesce("kept", F.lit(False))).alias("first"))
    return by.groupBy("key").agg(F.count(F.lit(1)).alias("terms"), F.count_if("any").alias("matched"), F.count_if("first").alias("used"))


def graded(pairs: DataFrame, dictionary: DataFrame, script: str = TIBETAN, marks: str = G.MARKS, terms: tuple[str, ...] = G.TERMS, most: int = 20) -> DataFrame:
    """A row for each of pairs (key, original, translation): terms, matched, used, confidence, the five aspects, overall, grade and
    to_work_on (names of the aspects under their floors). Null texts are empty; without a known term the coverage counts .5.
    """
    hits = dictionary_hits(pairs, dictionary, most)
    both = pairs.select("key", "original", "translation").join(hits, "key", "left").fillna(0, ["terms", "matched", "used"])
    coverage = F.col("matched") / F.when(F.col("terms") > 0, F.col("terms"))
    t, o = F.col("translation"), F.col("original")
    scored = both.select("key", "terms", "matched", "used", G.text_confidence(t, o, coverage, script, marks).alias("confidence"), *[c.alias(k) for k, c in G.aspects(t, o, F.col("used"), script, terms).items()])
    of = {k: F.col(k) for k in G.WEIGHTS}
    whole = scored.withColumn("overall", G.overall(of))
    return whole.select("*", G.grade(F.col("overall")).alias("grade"), G.to_work_on(of | {"overall": F.col("overall")}).alias("to_work_on"))
