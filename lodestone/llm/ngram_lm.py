"""Scoring texts with an n-gram model by deleted interpolation.

P(w | u v) mixes the maximum-likelihood estimates of all orders and a uniform share for words never seen. The weights
depend on how often the longest context was seen (in powers of two: the context-frequency bucket) and are learned by
expectation-maximisation: part of the training texts (the deleted part) is predicted with the counts of the rest, and
the weights are those that make it most probable. Texts are then scored with the counts of all training texts.

No table of n-grams is ever gathered in one place:

1. Texts are dealt into blocks by a hash of id and text, so that one id (or none) may have any number of texts. A block's distinct n-grams (as 64-bit hashes, sorted) and their
   counts go out as a few byte strings, one for each of many ranges of hashes.
2. All blocks' strings for a range meet, are added up, and each block gets the sums back in the order it asked.
3. Block by block the texts are read again beside the sums of their n-grams.

The deleted texts have blocks of their own, so that learning the weights reads only these. What comes to the driver are
the number of training tokens and distinct words, and the expected counts by bucket: predictions of the deleted tokens,
as a histogram of their probabilities in steps of a quarter octave for each order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textarrays as T
from lodestone.llm.common import crc_of_id, saved

#: Text bytes that a block holds, about.
BLOCK_BYTES = 12 << 20
BUCKETS = 24
END, START = np.uint64(0x45444F43), np.uint64(0x53544152)
#: Of the training texts, the share 1 / DELETED is deleted for the weights.
DELETED = 25
STEP = 4
LEVELS = 160


@dataclass
class Weights:
    mix: np.ndarray
    """For each bucket the weights of order n, n - 1, ..., 1 and of the uniform share."""


def _blocked(docs: DataFrame, train: Column, deleted: Column) -> tuple[DataFrame, int]:
    """docs as (doc_id, text, part, block). part: 0 not trained on, 1 deleted, 2 other training text."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(~train, 0).when(deleted, 1).otherwise(2).alias("part"))
    size = few.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(max(1, -(-size // BLOCK_BYTES)))
    less = max(1, blocks // DELETED)
    place = F.xxhash64("doc_id", "text")
    block = F.when(F.col("part") == 1, blocks + F.pmod(place, F.lit(less))).otherwise(F.pmod(place, F.lit(blocks)))
    return few.withColumn("block", block.cast("int")), blocks


def _tokens(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text with its end token, and where each text begins."""
    tokens, counts = [], []
    for c in T.chunks(texts):
        w = T.words(c)
        n = np.diff(w.offsets)
        out = np.empty(len(w.hashes) + len(n), np.uint64)
        ends = np.cumsum(n + 1) - 1
        word = np.ones(len(out), bool)
        word[ends] = False
        out[word] = w.hashes
        out[ends] = END
        tokens.append(out)
        counts.append(n + 1)
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(tokens), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _grams(tokens: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 1: the hash of the n-gram that ends at each token. Texts are preceded by start tokens."""
    out, before = [T.mix(tokens + np.uint64(1))], tokens
    total = tokens.copy()
    step = np.uint64(0x9E3779B97F4A7C15)
    scale = np.uint64(1)
    for _ in range(1, order):
        shifted = np.empty_like(before)
        shifted[1:] = before[:-1]
        if len(shifted):
            shifted[at[:-1]] = START
        before = shifted
        scale = scale * step
        total = total + T.mix(before) * scale
        out.append(T.mix(total + scale))
    return out


def _uint(values: np.ndarray) -> bytes:
    """Counts as bytes: one byte each where all are small."""
    kind = np.uint8 if not len(values) or values.max() < 256 else np.uint32 if values.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _back(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 4: np.uint32, 8: np.uint64}[data[0]], offset=1).astype(np.int64)


def _short(hashes: np.ndarray) -> bytes:
    """Seven bytes of each hash: a range of hashes shares its first byte's bits."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


def _split(order: int, ranges_log: int, texts: pa.Array, part: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """A block's n-grams and counts, by range."""
    tokens, at = _tokens(texts)
    of = np.repeat(part, np.diff(at))
    rows: dict[str, list] = {k: [] for k in ("block", "level", "range", "grams", "fit", "all")}
    for level, g in enumerate(_grams(tokens, at, order), 1):
        distinct, which = np.unique(g, return_inverse=True)
        fit = np.bincount(which, weights=of == 2, minlength=len(distinct)).astype(np.int64)
        every = np.bincount(which, weights=of > 0, minlength=len(distinct)).astype(np.int64)
        cuts = np.searchsorted(distinct >> np.uint64(64 - ranges_log), np.arange((1 << ranges_log) + 1, dtype=np.uint64))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            i, j = cuts[r], cuts[r + 1]
            for k, v in zip(rows, (block, level, r, _short(distinct[i:j]), _uint(fit[i:j]), _uint(every[i:j])), strict=True):
                rows[k].append(v)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    step = 64
    for i in range(0, len(rows["block"]), step):
        yield pa.RecordBatch.from_arrays([pa.array(v[i : i + step], kind) for v, kind in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _added(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The sums over all blocks of one range and level, for each block in its own order; with the range's totals."""
    grams = [_long(x) for x in table["grams"].to_pylist()]
    sizes = np.cumsum([len(g) for g in grams])[:-1]
    distinct, which = np.unique(np.concatenate(grams), return_inverse=True)
    sums = {}
    for name in ("fit", "all"):
        own = np.concatenate([_back(x) for x in table[name].to_pylist()])
        sums[name] = np.bincount(which, weights=own, minlength=len(distinct)).astype(np.int64)
    back = {name: [_uint(x) for x in np.split(v[which], sizes)] for name, v in sums.items()}
    n = table.num_rows
    totals = [[int(x)] + [0] * (n - 1) for x in (sums["fit"].sum(), (sums["fit"] > 0).sum(), sums["all"].sum(), (sums["all"] > 0).sum())]
    yield pa.RecordBatch.from_arrays(
        [table["block"].combine_chunks(), table["level"].combine_chunks(), table["range"].combine_chunks(), pa.array(back["fit"], pa.binary()), pa.array(back["all"], pa.binary()), *[pa.array(t, pa.int64()) for t in totals]],
        names=["block", "level", "range", "fit", "all", "fit_tokens", "fit_types", "all_tokens", "all_types"],
    )


def _counts(order: int, texts: pa.ChunkedArray, sums: pa.Table, which: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text begins, and the counts of each token's n-grams by order."""
    tokens, at = _tokens(texts)
    grams = _grams(tokens, at, order)
    by_level: dict[int, list[tuple[int, bytes]]] = {}
    for level, r, data in zip(sums["level"].to_pylist(), sums["range"].to_pylist(), sums[which].to_pylist(), strict=True):
        by_level.setdefault(level, []).append((r, data))
    out = []
    for level, g in enumerate(grams, 1):
        _, inverse = np.unique(g, return_inverse=True)
        known = np.concatenate([_back(d) for _, d in sorted(by_level[level], key=lambda x: x[0])])
        out.append(known[inverse])
    return at, out


def _estimates(at: np.ndarray, counts: list[np.ndarray], n_tokens: int, n_types: int, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each token by order (highest first) and the uniform share, and its context's bucket."""
    order, n = len(counts), len(counts[0])
    p = np.zeros((order + 1, n))
    for k in range(order, 1, -1):
        before = np.empty(n, np.int64)
        before[1:] = counts[k - 2][:-1]
        before[at[:-1]] = n_texts  # the context of start tokens only
        p[order - k] = np.where(before > 0, counts[k - 1] / np.maximum(before, 1), 0)
        if k == order:
            bucket = np.where(before > 0, 1 + np.floor(np.log2(np.maximum(before, 1))), 0).astype(np.int64)
    if order == 1:
        bucket = np.zeros(n, np.int64)
    p[order - 1] = counts[0] / max(1, n_tokens)
    p[order] = 1.0 / (n_types + 1)
    return p, np.minimum(bucket, BUCKETS - 1)


def _level(p: np.ndarray) -> np.ndarray:
    """Probabilities as quarter octaves; LEVELS stands for none."""
    return np.where(p > 0, np.clip(np.round(-np.log2(np.maximum(p, 1e-300)) * STEP), 0, LEVELS - 1), LEVELS).astype(np.int64)


def learn(histogram: dict[tuple[int, ...], int], order: int, uniform: float, rounds: int = 60) -> Weights:
    """EM over the deleted tokens' histogram {(bucket, level by order): tokens}."""
    mix = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    if not histogram:
        return Weights(mix)
    keys = np.array(list(histogram), np.int64)
    n = np.array(list(histogram.values()), np.float64)
    p = np.where(keys[:, 1:] < LEVELS, 2.0 ** (-keys[:, 1:] / STEP), 0)
    p = np.hstack([p, np.full((len(p), 1), uniform)])
    for _ in range(rounds):
        share = mix[keys[:, 0]] * p
        share *= (n / share.sum(axis=1))[:, None]
        new = np.zeros_like(mix)
        np.add.at(new, keys[:, 0], share)
        seen = new.sum(axis=1)
        # A bucket without deleted tokens keeps what it had; no weight of the two lowest orders becomes nothing.
        new[seen == 0] = mix[seen == 0]
        new[:, -2:] = np.maximum(new[:, -2:], 1e-6 * np.maximum(new.sum(axis=1, keepdims=True), 1))
        mix = new / new.sum(axis=1, keepdims=True)
    return Weights(mix)


def lm_scores(docs: DataFrame, train: Column, order: int = 2, deleted: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    train says which rows are learned from; deleted which of these the weights are learned from. Scores are log10. A
    null text is an empty one, whose only token is its end; rows with a null id are texts like others. Repeated rows
    count each time. Without training rows every token has the uniform share.
    """
    deleted = F.pmod(F.xxhash64(F.lit("deleted"), "doc_id"), F.lit(DELETED)) == 0 if deleted is None else deleted
    blocked, blocks = _blocked(docs, train, deleted)
    ranges_log = max(3, (blocks * 4 - 1).bit_length())

    def split(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({})
        return pa.Table.from_batches(list(_split(order, ranges_log, table["text"], table["part"].to_numpy(), table["block"][0].as_py())))

    asked = blocked.groupBy("block").applyInArrow(split, "block int, level int, range int, grams binary, fit binary, all binary")
    sums = saved(asked.groupBy("level", "range").applyInArrow(lambda t: pa.Table.from_batches(list(_added(t))), "block int, level int, range int, fit binary, all binary, fit_tokens long, fit_types long, all_tokens long, all_types long"))
    total = sums.where("level = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fit_tokens", "fit_types", "all_tokens", "all_types")]).first()
    texts = blocked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    texts = {r["part"]: r["n"] for r in texts}
    n_fit, n_all = texts.get(2, 0), texts.get(1, 0) + texts.get(2, 0)

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", *[f"p{k}" for k in range(order)], "n"]
        if not left.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in names})
        at, counts = _counts(order, left["text"], right, "fit")
        p, bucket = _estimates(at, counts, total["fit_tokens"], total["fit_types"], n_fit)
        keys = [bucket, *[_level(x) for x in p[:-1]]]
        code = np.zeros(len(bucket), np.int64)
        for k in keys:
            code = code * (LEVELS + 1) + k
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        return pa.table(dict(zip(names, [*[k[first] for k in keys], n], strict=True)))

    rows = blocked.where(F.col("part") == 1)
    schema = ", ".join(f"{k} long" for k in ["bucket", *[f"p{k}" for k in range(order)], "n"])
    tallied = rows.groupBy("block").cogroup(sums.where(F.col("block") >= blocks).select("block", "level", "range", "fit").groupBy("block")).applyInArrow(tally, schema)
    keys = ["bucket", *[f"p{k}" for k in range(order)]]
    histogram = {tuple(r[k] for k in keys): r["n"] for r in tallied.groupBy(*keys).agg(F.sum("n").alias("n")).collect()}  # at most BUCKETS * (LEVELS + 1) ** order rows
    weights = learn(histogram, order, 1.0 / (total["fit_types"] + 1))
    n_tokens, n_types = int(total["all_tokens"]), int(total["all_types"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), **{k: pa.array([], pa.int64()) for k in ("part", "n_tokens", "n_known", "train_tokens")}, "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        at, counts = _counts(order, left["text"], right, "all")
        p, bucket = _estimates(at, counts, n_tokens, n_types, n_all)
        mixed = np.log10((weights.mix[bucket].T * p).sum(axis=0))
        base = np.log10((counts[0] + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
        n = len(at) - 1
        return pa.table({
            "doc_id": left["doc_id"], "part": left["part"].cast(pa.int64()), "n_tokens": pa.array(np.diff(at)), "n_known": pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), at[:-1])),
            "train_tokens": pa.array(np.full(n, n_tokens)), "base_score": pa.array(np.add.reduceat(base, at[:-1])), "score": pa.array(np.add.reduceat(mixed, at[:-1])),
        })

    given = sums.select("block", "level", "range", "all")
    return blocked.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(score, "doc_id long, part long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_report(docs: DataFrame, order: int = 2) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod 5 is not 1; the other rows are held out."""
    crc = crc_of_id(F.col("doc_id"))
    out = lm_scores(docs, crc % 5 != 1, order, crc % DELETED == 2)
    return out.select("doc_id", (F.col("part") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
