"""Words and shingles of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Words are runs of bytes outside [\\x20\\x09-\\x0D], with A-Z lower-cased; each is known by a 64-bit hash. A chunk is a
few megabytes of whole texts, so that the arrays stay small whatever the length of a batch; a text longer than a chunk
is a chunk by itself. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: spreads differences over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Chunk(NamedTuple):
    first: int
    """Row of the first text in the column."""
    data: np.ndarray
    """Bytes of the texts, one after the other."""
    offsets: np.ndarray
    """Where each text begins, and the end of the last."""


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    n = len(data)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:n]
    np.cumsum(terms, out=sums[1:])
    h = (sums[stop] - sums[start]) * down[start]
    h += (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


class Words(NamedTuple):
    hashes: np.ndarray
    offsets: np.ndarray
    """Index of the first word of each text, and the number of all words."""
    prefixes: list[tuple[np.ndarray, np.ndarray]]
    """For each prefix length asked for: indexes of the words that are longer, and their prefixes' hashes."""


def words(chunk: Chunk, prefixes: tuple[int, ...] = ()) -> Words:
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.uint64)
        return Words(none, np.zeros(len(offsets), np.int64), [(none.astype(np.int64), none) for _ in prefixes])
    space = _WS[data]
    begins, ends = np.empty(n, bool), np.empty(n, bool)
    begins[0] = ends[-1] = True
    begins[1:] = space[:-1]
    ends[:-1] = space[1:]
    full = offsets[1:] > offsets[:-1]
    begins[offsets[:-1][full]] = True
    ends[offsets[1:][full] - 1] = True
    begins &= ~space
    ends &= ~space
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    terms = _LOW[data].astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:n]
    np.cumsum(terms, out=sums[1:])
    h = (sums[stop] - sums[start]) * down[start]
    h += (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    heads = []
    for size in prefixes:
        longer = np.flatnonzero(stop - start > size)
        at = start[longer]
        heads.append((longer, mix((sums[at + size] - sums[at]) * down[at] + np.uint64(size * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))))
    return Words(mix(h), np.searchsorted(start, offsets), heads)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles in order, repeats included, and the index of each text's first.

    A text of fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    counts = np.diff(w.offsets)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(per)))
    out = np.empty(out_offsets[-1], np.uint64)
    h = w.hashes
    if len(h) >= size:
        runs = gram(h, size)
        place = np.arange(len(runs))
        text = np.searchsorted(w.offsets, place, "right") - 1
        whole = place + size <= w.offsets[text + 1]
        out[out_offsets[text[whole]] + place[whole] - w.offsets[text[whole]]] = runs[whole]
    for few in range(1, size):
        at = np.flatnonzero(counts == few)
        if len(at):
            first = w.offsets[at]
            out[out_offsets[at]] = gram_at(h, first, few)
    return out, out_offsets


def gram(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size words from each word on."""
    return gram_at(h, np.arange(len(h) - size + 1), size) if len(h) >= size else np.zeros(0, np.uint64)


def gram_at(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    if size == 1:
        return mix(h[first] + np.uint64(1))
    steps, _ = _power_tables(size + 1)
    lead = len(first) and first[-1] - first[0] + 1 == len(first)
    total = np.full(len(first), size, np.uint64)
    for j in range(size):
        part = h[first[0] + j : first[0] + j + len(first)] if lead else h[first + j]
        total += part * steps[j + 1]
    return mix(total)
