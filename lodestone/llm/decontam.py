"""Benchmark items inside documents, by size-partitioned MinHash containment search.

An item leaks into a document if the document has at least ``threshold`` of the item's distinct 5-word shingles. Items
are partitioned by length: partition c holds those of 2 ** (c - 1) + 1 to 2 ** c shingles. For each partition documents
are cut into windows of 2 ** (c + 1) shingles that begin every 2 ** c, so that an item inside a document lies wholly in
some window not over four times its size, and the containment threshold becomes a similarity of at least 0.17. Items and
windows have MinHash signatures of COORDS coordinates; a window that agrees with an item of its partition in any
coordinate is a candidate (missed with a chance of at most about 4e-6). Candidates are verified by exact containment of
the item's shingles in the whole document.

Items of fewer than five words have one shingle, their whole word sequence; it is looked for at every place.

Items are the query side: they go to the executors in blocks of about BLOCK_BYTES of text, each block against all
documents. Where there are several blocks, one is on the executors at a time: its result is written before the next comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark.sql.types as S
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textarrays as T
from lodestone.llm.common import lean, saved

COORDS = 64
BLOCK_BYTES = 16 << 20
#: COORDS coordinates find what has at least this share of an item's shingles.
LEAST = 0.75

_rng = np.random.default_rng(77003)
_XOR = _rng.integers(0, 1 << 63, COORDS, np.uint64) * np.uint64(2)
_MUL = _rng.integers(0, 1 << 63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _permuted(v: np.ndarray, k: int) -> np.ndarray:
    v = v ^ _XOR[k]
    v *= _MUL[k]
    v ^= v >> np.uint64(32)
    return v


class Items:
    """One block of items: shingles, and by partition the coordinates' values."""

    def __init__(self, ids: list, texts: list[str], size: int) -> None:
        self.size, self.ids, self.sets = size, [], []
        lengths, short = [], {}
        for c in T.chunks(pa.array(texts, pa.string())):
            w = T.words(c)
            sh, at = T.shingles(w, size)
            for r, n_words in enumerate(np.diff(w.offsets).tolist()):
                if n_words == 0:
                    continue
                own = sh[at[r] : at[r + 1]]
                if n_words < size:
                    short.setdefault(n_words, []).append(len(self.ids))
                lengths.append(0 if n_words < size else len(own))
                self.ids.append(ids[c.first + r])
                self.sets.append(np.unique(own))
        self.short = {}
        """By number of words: the sorted hashes of the short items, and the items."""
        for n_words, items in short.items():
            values = np.array([self.sets[i][0] for i in items], np.uint64)
            order = np.argsort(values, kind="stable")
            self.short[n_words] = values[order], np.array(items)[order]
        lengths = np.array(lengths, np.int64)
        level = np.where(lengths > 0, np.ceil(np.log2(np.maximum(lengths, 1))), -1).astype(np.int64)
        self.levels = {}
        for c in np.unique(level[level >= 0]).tolist():
            of = np.flatnonzero(level == c)
            coords = []
            for k in range(COORDS):
                v = np.array([_permuted(self.sets[i], k).min() for i in of.tolist()], np.uint64)
                order = np.argsort(v, kind="stable")
                filter_ = np.zeros(1 << 16, bool)
                filter_[(v & np.uint64(0xFFFF)).astype(np.int64)] = True
                coords.append((v[order], of[order], filter_))
            self.levels[c] = coords

    def leaks(self, chunk: T.Chunk, threshold: float) -> list[tuple[int, int, int]]:
        """(text of the chunk, item, common shingles) of the items that leak."""
        w = T.words(chunk)
        sh, at = T.shingles(w, self.size)
        pairs = self._candidates(sh, at)
        out = []
        for text, item in sorted(pairs):
            own = self.sets[item]
            common = int(np.isin(own, sh[at[text] : at[text + 1]]).sum())
            if common >= threshold * len(own) - 1e-9:
                out.append((text, item, common))
        for n_words, (values, items) in self.short.items():
            grams = T.gram(w.hashes, n_words)
            a, b = np.searchsorted(values, grams, "left"), np.searchsorted(values, grams, "right")
            hit = np.flatnonzero(b > a)
            text = np.searchsorted(w.offsets, hit, "right") - 1
            inside = hit + n_words <= w.offsets[text + 1]
            found = {(t, int(x)) for t, i, j in zip(text[inside].tolist(), a[hit[inside]].tolist(), b[hit[inside]].tolist(), strict=True) for x in items[i:j]}
            out += [(t, x, 1) for t, x in found]
        return sorted(set(out))

    def _candidates(self, sh: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        if not len(sh) or not self.levels:
            return found
        low, high = min(self.levels), max(self.levels)
        # Where blocks of 2 ** c shingles begin in the blocks of the level below, and each text's first block.
        cuts, firsts, n = {}, {}, np.diff(at)
        first = at
        for c in range(low, high + 1):
            step = 1 << c if c == low else 2
            per = -(-n // step)
            begins = np.concatenate(([0], np.cumsum(per)))
            inner = np.arange(begins[-1]) - np.repeat(begins[:-1], per)
            cuts[c] = np.repeat(first[:-1], per) + inner * step
            firsts[c], first, n = begins, begins, per
        for k in range(COORDS):
            mins = _permuted(sh, k)
            for c in range(low, high + 1):
                mins = np.minimum.reduceat(mins, cuts[c])
                if c not in self.levels:
                    continue
                values, items, filter_ = self.levels[c][k]
                window = mins.copy()
                joined = np.ones(len(mins), bool)
                ends = firsts[c][1:]
                joined[ends[ends > firsts[c][:-1]] - 1] = False
                i = np.flatnonzero(joined[:-1])
                window[i] = np.minimum(mins[i], mins[i + 1])
                hit = np.flatnonzero(filter_[(window & np.uint64(0xFFFF)).astype(np.int64)])
                if not len(hit):
                    continue
                a, b = np.searchsorted(values, window[hit], "left"), np.searchsorted(values, window[hit], "right")
                for j in np.flatnonzero(b > a).tolist():
                    text = int(np.searchsorted(firsts[c], hit[j], "right")) - 1
                    found.update((text, int(x)) for x in items[a[j] : b[j]])
        return found


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """The items that have a text, in blocks of about BLOCK_BYTES of text."""
    some = benchmark.where("text is not null").select("item_id", "text").distinct()
    total = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK_BYTES // 2)))
    for k in range(blocks):
        rows = some.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        yield rows["item_id"].to_pylist(), rows["text"].to_pylist()


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_common, containment): a row for each document and item that leaks into it.

    Null and empty texts and items without words leak nothing; repeated rows of either table give a pair once. Without
    items or documents there are no rows. threshold is LEAST or more.
    """
    if threshold < LEAST:
        raise ValueError(f"containment under {LEAST} would be missed")
    key = docs.schema["doc_id"].dataType
    schema = S.StructType([S.StructField("doc_id", key), S.StructField("item_id", benchmark.schema["item_id"].dataType), S.StructField("n_item_shingles", S.LongType()), S.StructField("n_common", S.LongType())])
    parts, last = [], None
    for ids, texts in item_blocks(benchmark):
        if last is not None:
            parts[-1] = saved(parts[-1])
            last.destroy()
        block = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, size))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = block.value
            for b in batches:
                rows = []
                for c in T.chunks(b.column("text")):
                    rows += [(c.first + text, item, common) for text, item, common in items.leaks(c, threshold)]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), pa.array([items.ids[r[1]] for r in rows]), pa.array([len(items.sets[r[1]]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())] if rows else [b.column("doc_id").slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64())],
                    names=["doc_id", "item_id", "n_item_shingles", "n_common"],
                )

        parts.append(docs.select("doc_id", "text").mapInArrow(lean(run), schema))
        last = block
    found = reduce(DataFrame.unionByName, parts)
    found = found.groupBy("doc_id", "item_id", "n_item_shingles").agg(F.max("n_common").alias("n_common"))
    return found.withColumn("containment", F.col("n_common") / F.col("n_item_shingles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """The rows of docs that no item leaks into, all columns as they were; one pass over docs for each block of items.

    Null and empty texts stay, repeated rows all stay or all go. threshold is LEAST or more.
    """
    if threshold < LEAST:
        raise ValueError(f"containment under {LEAST} would be missed")
    last = None
    for ids, texts in item_blocks(benchmark):
        if last is not None:
            docs = saved(docs)
            last.destroy()
        block = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, size))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for c in T.chunks(b.column("text")):
                    clean[[c.first + text for text, _, _ in block.value.leaks(c, threshold)]] = False
                yield b.filter(pa.array(clean))

        docs, last = docs.mapInArrow(lean(run), docs.schema), block
    return docs
