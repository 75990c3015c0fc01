"""Sentences and chunks of documents that come as rows of pages, however long a document is.

No step holds a document in one value. A document whose pages are all in one range of RANGE pages is read row by row, in order, and
its text is shuffled once. In a longer one, what runs on from page to page - open brackets, the sentence that is not ended, the
tokens of the open chunk - is carried over in two steps: each range gives what it does to any state that it may
be entered with, these are composed along the document, and then each range is worked on by itself with the state it begins with.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import TIBETAN, token_estimate
from lodestone.session import materialised

RANGE = 4096
#: What ends a sentence, and words after which a dot does not.
ENDS, ABBREVIATIONS = "།༎.!?", ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "etc", "e.g", "i.e")
MARKS = re.compile(f"[(){re.escape(ENDS)}]")
PLAIN_ENDS = re.compile(f"[{re.escape(ENDS)}]" + "".join(rf"(?<!{re.escape(a)}\.)" for a in ABBREVIATIONS))
#: Characters after which rows go on to the next step.
BATCH = 1 << 22


def running_before(rows: DataFrame, key: str, place: str, value: Column, name: str) -> DataFrame:
    """rows with name: the sum of value over the rows of the same key at smaller places (unique, from 0), by ranges of places."""
    part = rows.withColumns({"_v": value, "_r": F.expr(f"{place} div {RANGE}")})
    ranges = part.groupBy(key, "_r").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    begun = ranges.withColumn("_b", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s").withColumnRenamed(key, "_k")
    inside = Window.partitionBy(key, "_r").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    own = part.withColumn("_w", F.coalesce(F.sum("_v").over(inside), F.lit(0))).withColumnRenamed("_r", "_q")
    both = own.join(begun, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_q") == F.col("_r")))
    return both.withColumn(name, F.col("_b") + F.col("_w")).drop("_k", "_r", "_q", "_v", "_w", "_b")


def pieces(text: str, depth: int) -> list[tuple[str, bool]]:
    """The text cut after each end of a sentence, entered with depth open brackets: (piece, whether it ends a sentence).

    A mark ends a sentence unless more brackets were opened than closed before it, or it is a dot after an abbreviation.
    """
    out, last = [], 0
    if depth <= 0 and "(" not in text:  # no mark is within brackets
        for m in PLAIN_ENDS.finditer(text):
            out.append((text[last : m.end()], True))
            last = m.end()
        if last < len(text):
            out.append((text[last:], False))
        return out
    for m in MARKS.finditer(text):
        i, c = m.start(), m[0]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c in ENDS and depth <= 0 and not (c == "." and text[max(0, i - 10) : i].endswith(ABBREVIATIONS)):
            out.append((text[last : i + 1], True))
            last = i + 1
    if last < len(text):
        out.append((text[last:], False))
    return out


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _ranges(pages: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, g, last, more) of each document: its first and last range, as a table."""
    g = F.expr(f"page div {RANGE}")
    return materialised(pages.groupBy("doc_id").agg(F.min(g).alias("g"), F.max(g).alias("last"), *more))


def _only(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The pages of these documents."""
    return pages.join(documents.select(F.col("doc_id").alias("_d")), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")


def _in_order(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, serial, whole, text) of documents (doc_id, g, whole), whose pages are all in range g: a whole one as it is (pages
    joined by a blank), of another each sentence, trimmed, if anything is left. Rows of a document, one serial, follow each other in order.
    """
    kind, page = (pages.schema[c].dataType.simpleString() for c in ("doc_id", "page"))
    rows = pages.where("text is not null and text <> ''").select("doc_id", F.expr(f"page div {RANGE}").alias("g"), "page", "text", F.lit(None).cast("boolean").alias("whole"))
    heads = documents.select("doc_id", "g", F.lit(None).cast(page).alias("page"), F.lit(None).cast("string").alias("text"), "whole")
    order = Window.partitionBy("doc_id", "g").orderBy(F.asc_nulls_first("page"))
    placed = rows.unionByName(heads).withColumn("n", F.row_number().over(order)).select("doc_id", "n", "whole", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, whole, depth, opened, held = -1, None, 0, [], 0
        texts: list[str] = []
        of: list[tuple] = []  # of each document: its id, serial, whether it is whole, and where its texts begin

        def end() -> None:
            if opened:
                texts.append(opened[0] if len(opened) == 1 else " ".join(opened))
                opened.clear()

        def made(kind: pa.DataType) -> pa.RecordBatch:
            docs, serials, wholes, begun = zip(*of, strict=True)
            row = pa.array(np.repeat(np.arange(len(of)), np.diff([*begun, len(texts)])))
            out = pa.RecordBatch.from_arrays([pa.array(docs, kind).take(row), pa.array(serials, pa.int64()).take(row), pa.array(wholes, pa.bool_()).take(row), pa.array(texts, pa.string())], names=["doc_id", "serial", "whole", "text"])
            texts.clear()
            of[:] = [(*of[-1][:3], 0)]
            return out

        doc_type = None
        for b in batches:
            doc_type = b.schema.field("doc_id").type
            for d, n, w, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "whole", "text")), strict=True):
                if n == 1:  # the head of a document, or the first page of one that is not asked for
                    end()
                    serial, whole, depth = serial + 1, w, 0
                    of.append((d, serial, w, len(texts)))
                if t is None or whole is None:
                    continue
                held += len(t)
                if whole:
                    opened.append(t)
                    continue
                for piece, ends in pieces(t, depth):
                    opened.append(piece)
                    if ends:
                        end()
                if depth or "(" in t or ")" in t:
                    depth += t.count("(") - t.count(")")
                if held >= BATCH and texts:
                    held = 0
                    yield made(doc_type)
        end()
        if texts:
            yield made(doc_type)

    parts = placed.mapInArrow(cut, f"doc_id {kind}, serial long, whole boolean, text string")
    return parts.select("doc_id", "serial", "whole", F.when(F.col("whole"), F.col("text")).otherwise(_trimmed(F.col("text"))).alias("text")).where("text <> ''")


def sentences(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence) of pages (doc_id, page, text): trimmed sentences in order from 0, also those that go on over page ends.

    Where a sentence goes on, the pages' texts are joined by a blank. Blank and null pages say nothing. doc_id and page are
    unique together; a null doc_id is a document too. A sentence is held whole, so text without any mark is one value.
    """
    kind = pages.schema["doc_id"].dataType.simpleString()
    some = pages.where("text is not null and text <> ''")
    documents = _ranges(some)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, pos = None, -1
        for b in batches:
            at = []
            for s in b.column("serial").to_pylist():
                serial, pos = s, pos + 1 if s == serial else 0
                at.append(pos)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(at, pa.int64()), b.column("text")], names=["doc_id", "pos", "sentence"])

    said = _in_order(some, documents.where("g = last").withColumn("whole", F.lit(False))).mapInArrow(numbered, f"doc_id {kind}, pos long, sentence string")
    long = documents.where("g < last")
    return said if long.isEmpty() else said.unionByName(_sentences_by_range(_only(some, long)))


def _sentences_by_range(pages: DataFrame) -> DataFrame:
    """sentences() of documents of many ranges."""
    some = pages.where("text is not null and text <> ''").select("doc_id", "page", "text")
    order = Window.partitionBy("doc_id", F.expr(f"page div {RANGE}")).orderBy("page")
    numbered = materialised(some.withColumns({"_n": F.row_number().over(order), "_g": F.expr(f"page div {RANGE}")}))
    sizes = numbered.groupBy("doc_id", "_g").agg(F.count(F.lit(1)).alias("_c"))
    first = sizes.withColumn("_f", F.coalesce(F.sum("_c").over(Window.partitionBy("doc_id").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("doc_id").alias("_d"), F.col("_g").alias("_h"), "_f")
    placed = numbered.join(first, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_g") == F.col("_h"))).select("doc_id", (F.col("_f") + F.col("_n") - 1).alias("place"), "text")
    opened = F.regexp_count("text", F.lit(r"\(")) - F.regexp_count("text", F.lit(r"\)"))
    deep = running_before(placed, "doc_id", "place", opened.cast("long"), "depth")
    kind = pages.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [pieces(t, d) for t, d in zip(b.column("text").to_pylist(), b.column("depth").to_pylist(), strict=True)]
            row = pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each]))
            flat = [p for e in each for p in e]
            nth = pa.array([i for e in each for i in range(len(e))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("place").take(row), nth, pa.array([t for t, _ in flat], pa.string()), pa.array([int(e) for _, e in flat], pa.int64())], names=["doc_id", "place", "nth", "piece", "ends"])

    cut_up = materialised(deep.select("doc_id", "place", "text", "depth").mapInArrow(cut, f"doc_id {kind}, place long, nth long, piece string, ends long"))
    per_page = cut_up.groupBy("doc_id", "place").agg(F.sum("ends").alias("ended"))
    ended = running_before(per_page, "doc_id", "place", F.col("ended"), "before").select(F.col("doc_id").alias("_d"), F.col("place").alias("_p"), "before")
    on_page = cut_up.join(ended, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("place") == F.col("_p")))
    # All pieces of a page but the last end a sentence, so a piece's number is its place on the page more than those before the page.
    joined = on_page.withColumn("number", F.col("before") + F.col("nth")).groupBy("doc_id", "number").agg(F.array_sort(F.collect_list(F.struct("place", "nth", "piece"))).alias("p"))
    text = _trimmed(F.array_join(F.transform("p", lambda x: x["piece"]), " "))
    whole = joined.select("doc_id", "number", text.alias("sentence")).where("sentence <> ''")
    # Numbers of blank sentences are left out.
    part = whole.withColumn("_r", F.expr(f"number div {RANGE}"))
    count = part.groupBy("doc_id", "_r").agg(F.count(F.lit(1)).alias("_c")).withColumn("_f", F.coalesce(F.sum("_c").over(Window.partitionBy("doc_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    count = count.select(F.col("doc_id").alias("_d"), F.col("_r").alias("_q"), "_f")
    inside = part.withColumn("_i", F.row_number().over(Window.partitionBy("doc_id", "_r").orderBy("number")))
    return inside.join(count, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_r") == F.col("_q"))).select("doc_id", (F.col("_f") + F.col("_i") - 1).alias("pos"), "sentence")


def break_table(tokens: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a range of sentences does: for each first break b (0 .. the sentences that fit one budget; the last: none) the tokens
    that must fit before it, and, if a chunk begins there, the chunks begun in the range and the tokens open at its end."""
    total = np.concatenate(([0], np.cumsum(tokens)))
    n = len(tokens)
    reach = min(n, int(np.searchsorted(total, budget, "right")))  # breaks at 0 .. reach
    following = np.maximum(np.searchsorted(total, total[:-1] + budget, "right") - 1, np.arange(n) + 1)
    begun, open_ = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = int(following[i])
        begun[i] = 1 + (begun[j] if j < n else 0)
        open_[i] = open_[j] if j < n else total[n] - total[i]
    return total[: reach + 1], begun[: reach + 1], open_[: reach + 1]


def first_break(total: np.ndarray, n: int, open_: int, budget: int) -> int:
    """The first sentence that does not fit a chunk that open_ tokens are in (0: none, then the first sentence fits); n if all do."""
    b = int(np.searchsorted(total, budget - open_, "right")) - 1
    return min(n, max(b, 1 if open_ == 0 else 0))


def chunk_numbers(tokens: DataFrame, budget: int = 3500) -> DataFrame:
    """(doc_id, pos, chunk) of tokens (doc_id, pos, tokens; pos from 0): a sentence goes to the open chunk while its tokens fit the
    budget, else it begins the next; a chunk has one sentence at least. Sentences have one token at least.
    """
    kind = tokens.schema["doc_id"].dataType.simpleString()
    part = materialised(tokens.select("doc_id", "pos", "tokens", F.expr(f"pos div {RANGE}").alias("r")))

    def tables(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t["tokens"].to_numpy()
        total, begun, open_ = break_table(n, budget)
        return pa.table({"doc_id": t["doc_id"].slice(0, 1).combine_chunks(), "r": t["r"].slice(0, 1).combine_chunks(), "n": [len(n)], "sum": [int(n.sum())], "total": [total.tolist()], "begun": [begun.tolist()], "open_": [open_.tolist()]})

    def states(t: pa.Table) -> pa.Table:
        """Along the ranges of a document: the tokens and chunks that each begins with. A row of a range has a budget's sentences at most."""
        t = t.sort_by("r")
        at, done, first = 0, 0, []
        for n, s, total, begun, open_ in zip(*(t[c].to_pylist() for c in ("n", "sum", "total", "begun", "open_")), strict=True):
            first.append((at, done))
            b = first_break(np.array(total), n, at, budget)
            if b == n:
                at += s
            else:
                at, done = open_[b], done + begun[b]
        return pa.table({"doc_id": t["doc_id"], "r": t["r"], "at": pa.array([a for a, _ in first], pa.int64()), "done": pa.array([d for _, d in first], pa.int64())})

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        t = left.sort_by("pos")
        n = t["tokens"].to_numpy()
        at, done = right["at"][0].as_py(), right["done"][0].as_py()
        total = np.concatenate(([0], np.cumsum(n)))
        chunk = np.full(len(n), done, np.int64)
        b = first_break(total, len(n), at, budget)
        while b < len(n):
            done += 1
            chunk[b:] = done
            b = max(int(np.searchsorted(total, total[b] + budget, "right")) - 1, b + 1)
        return pa.table({"doc_id": t["doc_id"], "pos": t["pos"], "chunk": pa.array(chunk)})

    summary = part.groupBy("doc_id", "r").applyInArrow(tables, f"doc_id {kind}, r long, n long, sum long, total array<long>, begun array<long>, open_ array<long>")
    begun = summary.groupBy("doc_id").applyInArrow(states, f"doc_id {kind}, r long, at long, done long")
    return part.groupBy("doc_id", "r").cogroup(begun.groupBy("doc_id", "r")).applyInArrow(number, f"doc_id {kind}, pos long, chunk long")


def chunks(pages: DataFrame, budget: int = 3500, overlap: float = 0.1, script: str = TIBETAN) -> DataFrame:
    """(doc_id, chunk, text, tokens, overlap) of pages (doc_id, page, text): sentences, over page ends too, put together by chunk_numbers.

    A document whose estimate fits the budget is one chunk, its text as it is (pages joined by a blank). tokens is the estimate
    of the chunk's text; overlap is the last tenth (by characters, rounded down) of the chunk before, empty for the first.
    Documents without a sentence have no chunk; a null doc_id is a document too.
    """
    kind = pages.schema["doc_id"].dataType.simpleString()
    documents = _ranges(pages, _size(script))
    short = (F.col("size") <= budget) & (F.col("size") > 0)
    ordered = _in_order(pages, documents.where("g = last").select("doc_id", "g", short.alias("whole")))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, serial, chunk, before, opened, tokens, held = None, None, 0, "", [], 0, 0
        out: list[tuple] = []

        def end() -> None:
            nonlocal chunk, before, tokens
            if opened:
                text, n = " ".join(opened), math.floor(len(before) * overlap)
                out.append((doc, chunk, text, before[-n:] if n > 0 else ""))
                chunk, before, tokens = chunk + 1, text, 0
                opened.clear()

        def made(of: pa.DataType) -> pa.RecordBatch:
            docs, numbers, texts, overlaps = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(docs, of), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(overlaps, pa.string())], names=["doc_id", "chunk", "text", "overlap"])

        of = None
        for b in batches:
            of = b.schema.field("doc_id").type
            for d, s, t, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "serial", "text", "tokens")), strict=True):
                if s != serial:
                    end()
                    doc, serial, chunk, before = d, s, 0, ""
                elif tokens + n > budget:
                    end()
                opened.append(t)
                tokens += n
                held += len(t)
                if held >= BATCH and out:
                    held = 0
                    yield made(of)
        end()
        if out:
            yield made(of)

    tokens = F.when(F.col("whole"), 1).otherwise(F.greatest(token_estimate(F.col("text"), script), F.lit(1)))
    made = ordered.select("doc_id", "serial", "text", tokens.cast("long").alias("tokens")).mapInArrow(put, f"doc_id {kind}, chunk long, text string, overlap string")
    long = documents.where("g < last")
    if not long.isEmpty():
        made = made.unionByName(_chunks_by_range(_only(pages, long), budget, overlap, script))
    return made.select("doc_id", "chunk", "text", token_estimate(F.col("text"), script).alias("tokens"), "overlap")


def _size(script: str) -> Column:
    """The estimate of a document's tokens, over its pages."""
    whole = F.coalesce("text", F.lit(""))
    signs, rest = F.regexp_count(whole, F.lit(script)), F.regexp_count(F.regexp_replace(whole, script, " "), F.lit(r"\S+"))
    return (F.ceil(F.sum(signs) / 4.0) + F.ceil(F.sum(rest) * F.lit(1.3))).alias("size")


def _chunks_by_range(pages: DataFrame, budget: int, overlap: float, script: str) -> DataFrame:
    """(doc_id, chunk, text, overlap) of chunks() of documents of many ranges."""
    size = pages.groupBy("doc_id").agg(_size(script))
    short = size.where((F.col("size") <= budget) & (F.col("size") > 0)).select(F.col("doc_id").alias("_d"))
    same = F.col("doc_id").eqNullSafe(F.col("_d"))
    few = pages.join(short, same, "left_semi").where("text <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    ones = few.select("doc_id", F.lit(0).cast("long").alias("chunk"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))
    said = materialised(_sentences_by_range(pages.join(short, same, "left_anti")))
    numbers = chunk_numbers(said.select("doc_id", "pos", F.greatest(token_estimate(F.col("sentence"), script), F.lit(1)).alias("tokens")), budget)
    at = numbers.select(F.col("doc_id").alias("_d"), F.col("pos").alias("_p"), "chunk")
    joined = said.join(at, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("pos") == F.col("_p"))).groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"))
    made = materialised(joined.select("doc_id", "chunk", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("text")).unionByName(ones))
    before = made.select(F.col("doc_id").alias("_d"), (F.col("chunk") + 1).alias("_c"), F.expr(f"right(text, cast(floor(char_length(text) * {overlap}D) as int))").alias("overlap"))
    out = made.join(before, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("chunk") == F.col("_c")), "left")
    return out.select("doc_id", "chunk", "text", F.coalesce("overlap", F.lit("")).alias("overlap"))
