"""Periodic runs of words: the harmonic grid with longest common extensions from suffix arrays.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and at least
max(MIN_LENGTH, MIN_POWER * q) words that no neighbouring word extends keeping period q.

For each period p the positions 0, p, 2p, ... form a grid. A run of period p has MIN_POWER = 4 neighbouring points of it
inside, so a point x counts if the words at x, x+p, x+2p and x+3p are the same (elsewhere the forward extension of one
of these pairs is 0, and there is nothing to ask). There the common extension of x and x+p is asked for forward (suffix
array, common prefixes of its neighbours, range minima) and backward (the same of the reversed words); both give the
whole stretch. The same stretch comes once more for each multiple of its smallest period; the smallest stays.

The texts of a batch that have such points are laid end to end, parted by numbers of their own, and share their arrays.
A document is worked on in one task; it needs about 200 bytes a word while its extensions are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as S
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_of_id, without

MIN_LENGTH, MIN_POWER = 6, 4
#: Words of the texts that share one suffix array, about; a longer text has its own.
SHARED_WORDS = 1 << 17
#: Longest text whose grid comes from a table; grids of longer ones are made a part of GRID_PART points at a time.
TABLE_WORDS, GRID_PART = 1 << 15, 1 << 20

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _points(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points x with x+3p < n, and their periods p, for low <= p < high."""
    p = np.arange(low, high)
    count = np.maximum((n - 1) // p - 2, 0)
    p = np.repeat(p, count)
    x = (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * p
    return x, p


_table: list[np.ndarray] = []


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All grid points of a text of n words, with their periods, in parts."""
    if n <= TABLE_WORDS:
        if not _table:  # in the order of x+3p, so that each text's points come first
            x, p = _points(TABLE_WORDS, 1, TABLE_WORDS // 3 + 1)
            order = np.argsort(x + 3 * p, kind="stable")
            _table[:] = x[order].astype(np.int32), p[order].astype(np.int32), np.searchsorted((x + 3 * p)[order], np.arange(TABLE_WORDS + 1))
        x, p, upto = _table
        yield x[: upto[n]], p[: upto[n]]
        return
    low, last = 1, (n - 1) // 3
    while low <= last:
        high = low + max(1, min(last, GRID_PART * low // n))
        yield _points(n, low, min(high, last + 1))
        low = high


def grid_candidates(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points x and periods p with the same word at x, x+p, x+2p and x+3p."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for x, p in _grid(len(ids)):
        at = ids[x]
        hit = np.flatnonzero(at == ids[x + p])
        x, p, at = x[hit].astype(np.int64), p[hit].astype(np.int64), at[hit]
        same = (ids[x + 2 * p] == at) & (ids[x + 3 * p] == at)
        found.append((x[same], p[same]))
    return np.concatenate([x for x, _ in found]), np.concatenate([p for _, p in found])


class Extensions:
    """Longest common extensions to the right of two positions; the sequence ends with a number that it has nowhere else."""

    def __init__(self, sequence: np.ndarray) -> None:
        n = len(sequence)
        rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
        levels, step = [], 1
        while True:  # ranks of the next 1, 2, 4 ... numbers, until all differ
            levels.append(rank.astype(np.int32))
            if rank.max() == n - 1:
                break
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[0] = 0
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            step *= 2
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        prefix = np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 2, -1, -1):  # what two neighbours share, by falling powers of two
            same = np.flatnonzero(levels[k][a] == levels[k][b])
            for of in (a, b, prefix):
                of[same] += 1 << k
        del levels
        self.minima = [prefix.astype(np.int32)]
        while 2 << (len(self.minima) - 1) <= len(prefix):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different positions the number of equal items from there on."""
        ri, rj = self.rank[i], self.rank[j]
        low, high = np.minimum(ri, rj), np.maximum(ri, rj)  # minimum of prefix[low:high]
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            of = self.minima[k]
            out[at] = np.minimum(of[low[at]], of[high[at] - (1 << k)])
        return out


def _numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def runs_of(texts: list[np.ndarray], points: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each text (numbers of its words) the runs at its grid points: rows (start, length, period) by start and period."""
    top = max(int(t.max()) for t in texts) + 1
    parts, begins, at = [], [], 1
    for k, t in enumerate(texts):
        parts += [np.array([top + k]), t]
        begins.append(at)
        at += len(t) + 1
    line = np.concatenate([*parts, [top + len(texts)]])
    n = len(line)
    x = np.concatenate([p[0] + b for p, b in zip(points, begins, strict=True)])
    p = np.concatenate([p[1] for p in points])
    text = np.repeat(np.arange(len(texts)), [len(q[0]) for q in points])
    forward = Extensions(line)(x, x + p)
    backward = Extensions(line[::-1])(n - x, n - x - p)  # from x-1 and x+p-1 to the left
    start, length = x - backward, p + forward + backward
    long = np.flatnonzero(length >= np.maximum(MIN_LENGTH, MIN_POWER * p))
    start, length, p, text = start[long], length[long], p[long], text[long]
    order = np.lexsort((p, length, start))
    start, length, p, text = start[order], length[order], p[order], text[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    rows = np.stack([start[new] - np.array(begins)[text[new]], length[new], p[new]], axis=1)
    text = text[new]
    order = np.lexsort((rows[:, 2], rows[:, 0], text))
    rows = rows[order]
    return np.split(rows, np.searchsorted(text[order], np.arange(1, len(texts))))


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by single blanks."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        gone = np.cumsum(change)[:-1] > 0
        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
    return b" ".join(words)


def _batch(texts: pa.Array) -> tuple[list[np.ndarray], list[bytes]]:
    none = np.zeros((0, 3), np.int64)
    runs, collapsed = [none] * len(texts), [b""] * len(texts)
    waiting: list[tuple[int, list[bytes], np.ndarray, tuple[np.ndarray, np.ndarray]]] = []

    def ask() -> None:
        if waiting:
            for (k, words, _, _), found in zip(waiting, runs_of([w[2] for w in waiting], [w[3] for w in waiting]), strict=True):
                runs[k], collapsed[k] = found, collapse(words, found)
            waiting.clear()

    words_waiting = 0
    for k, value in enumerate(texts):
        words = (value.as_py() or "").encode().split()  # at ASCII white space
        ids = _numbered(words)
        points = grid_candidates(ids) if len(words) >= MIN_LENGTH else (none, none)
        if not len(points[0]):
            collapsed[k] = b" ".join(words)
            continue
        if waiting and words_waiting + len(words) > SHARED_WORDS:
            ask()
            words_waiting = 0
        waiting.append((k, words, ids, points))
        words_waiting += len(words)
    ask()
    return runs, collapsed


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _runs (array of start, length, period in words, by start and period) and _collapsed (the text without the
    words that any run holds after its first period, single blanks between words); columns of docs of these names give way.

    Words are parted by [\\x20\\x09-\\x0D] and compared as they are. Null and empty texts, and those of fewer than
    MIN_LENGTH words, have no run. Every row counts, with a null or repeated id too; an empty table gives no rows.
    """
    docs = without(docs, "_runs", "_collapsed")
    run_type = S.ArrayType(S.StructType([S.StructField(f, S.LongType()) for f in ("start", "length", "period")]))
    schema = S.StructType([*docs.schema.fields, S.StructField("_runs", run_type), S.StructField("_collapsed", S.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, collapsed = _batch(b.column(text_col))
            flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            ends = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends), structs)
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*b.schema.names, "_runs", "_collapsed"])

    return docs.mapInArrow(find, schema)


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each tenth document by the hash h of its id goes on in a loop, as the contract of the query has it.

    With n words and g = h // 10, the words from a = g % n on repeat the first 1 + (n-a) // (3 + g % 8) of them.
    """
    h = crc_of_id(F.col("doc_id"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr("CAST(NULL AS array<string>)").alias("_w"), h.alias("_h"))
    few = few.withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumns({"_n": F.size("_w").cast("long"), "_g": F.floor(F.col("_h") / 10)})
    few = few.withColumn("_a", F.when(F.col("_n") > 0, F.pmod("_g", "_n")))
    few = few.withColumn("_p", F.lit(1) + F.expr("(_n - _a) div (3 + _g % 8)"))
    loop = F.expr("concat_ws(' ', slice(_w, 1, cast(_a as int)), transform(sequence(_a, _n - 1), i -> _w[cast(_a + (i - _a) % _p as int)]))")
    return few.select("doc_id", F.when(F.col("_a").isNotNull(), loop).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    start to exponent_milli are those of the longest run (ties: smallest start, then period), null where there is none.
    """
    found = periodic_runs(docs)
    best = F.array_max(F.transform("_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("_runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("_runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("_collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.s"), F.col("best.length"), -F.col("best.p")
    milli = F.expr("(1000 * best.length) div (-best.p)")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
