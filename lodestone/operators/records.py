"""Raw records made regular, temporary ids resolved, translations that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that stand for anybody.
GENERIC = ("teacher", "the teacher", "master", "the master", "lama", "the lama", "student", "disciple", "monk", "a monk", "king", "the king", "deity", "buddha", "he", "she", "they", "unknown")
#: Words that tell a record's type; the first that fits counts.
TYPES = {"person": r"person|people|human|monk|teacher", "place": r"place|location|region|city", "institution": r"institution|monastery|temple|school", "text": r"text|book|sutra|work", "event": r"event|ceremony|meeting"}


def named(entities: DataFrame, types: tuple[str, ...] = ("person", "deity")) -> DataFrame:
    """entities without those of the types whose name is missing or stands for anybody."""
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    return entities.where(~F.col("type").isin(*types) | ~(name.isin(*GENERIC) | (name == "")))


def typed(kind: Column, default: str = "concept") -> Column:
    out = F.lit(default)
    for value, pattern in reversed(TYPES.items()):
        out = F.when(F.lower(kind).rlike(pattern), value).otherwise(out)
    return out


def regular(raw: DataFrame) -> DataFrame:
    """(id, type, names, confidence) of raw records (id, kind, names, confidence; all texts): kinds as types by keyword, names parted at
    ; or | and trimmed without blanks and repeats, confidence as a number from 0 to 1, .5 where it is none."""
    names = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("names", F.lit("")), r"[;|]"), lambda n: F.trim(n)), lambda n: n != ""))
    c = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5))
    return raw.select("id", typed(F.coalesce("kind", F.lit(""))).alias("type"), names.alias("names"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)).alias("confidence"))


def with_real_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with src and dst as real ids, by ids (temp, real); edges with an end that has none are left out."""
    side = lambda c: ids.select(F.col("temp").alias(c), F.col("real").alias(f"_{c}"))
    out = edges.join(side("src"), "src").join(side("dst"), "dst")
    return out.select(*[F.col(f"_{c}").alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns])


def changed_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(term, old, new): terms whose translation (term, target, page) was changed; of several, that of the first page counts."""
    first = lambda df, name: df.groupBy("term").agg(F.min_by("target", F.struct("page", "target")).alias(name))
    return first(before, "old").join(first(after, "new"), "term").where("old <> new")
