"""Helpers that the training-data operators share: columns set aside, hashes of ids; tables come from lodestone.session."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialised as saved
from lodestone.session import table

__all__ = ["LOWER", "UPPER", "WHITESPACE", "ascii_lower", "crc_of_id", "lean", "partitions", "put_back", "release_memory", "saved", "set_aside", "table", "without"]

#: The characters that separate words and pad lines, as the contracts fix them.
WHITESPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without its own columns of these names (in any case), which a result column of that name replaces."""
    low = {n.lower() for n in names}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in low])


def set_aside(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, text, _rest): all other columns, whatever their names, in one struct (null if there are none)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("_rest"))


def put_back(packed: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns in their order from (doc_id, text, _rest); changed gives some of them new values."""
    return packed.select(*[changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c]).alias(c) for c in columns])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_of_id(c: Column) -> Column:
    """crc32 of the id's decimal text; null ids hash as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Gives a task's freed memory back to the system: its worker stays and may next serve a task that needs little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with release_memory() when its batches are done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped
