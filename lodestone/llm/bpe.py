"""Byte-level BPE encoding and decoding by one merge replay over the distinct words of the whole corpus.

1. Rows are packed into compressed blocks of about BLOCK_BYTES of text, each a row that goes to one task.
2. A block's distinct words (matches of the split pattern) are dealt over buckets by their checksum; so each distinct word of
   all texts is in one bucket, whatever the number of texts and blocks that hold it.
3. A bucket's words are laid out as one long sequence with links to each position's neighbours. An inverted index, from a
   pair of neighbouring tokens to the positions where it stands, is kept by the rank of the pair's merge. Merges are applied
   in rank order, each to all of its positions at once; only the pairs of the touched neighbours are looked up and indexed anew.
4. Words' ids go back to the blocks that asked for them, where texts are put together from them.

A word's tokens are those of the greedy rule (always the lowest rank, leftmost first). A merge can make a pair whose
rank is not above its own; the index holds it for the next step, and where that could change the order of merges
inside one word, the word is encoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as S
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textarrays as T
from lodestone.llm.common import lean, partitions, release_memory, without

#: Bytes of text in a block, and those that are split at once.
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 2 << 20
#: Bytes of words that share an inverted index; with more in a bucket there are several.
REPLAY_BYTES = 4 << 20
_NONE = 1 << 30


class RegexSplitter:
    """Words by any pattern, text by text."""

    def __init__(self, pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).finditer

    def spans(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, stop, first = [], [], [0]
        for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
            text = chunk.data[a:b].tobytes().decode()
            size = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text]))).astype(np.int64) + a
            for m in self.find(text):
                start.append(size[m.start()])
                stop.append(size[m.end()])
            first.append(len(start))
        return np.array(start, np.int64), np.array(stop, np.int64), np.array(first)


class ArraySplitter:
    """Words by the one pattern that byte-level BPE vocabularies usually come with, for all texts of a chunk at once.

    Each character is a letter, a number, white space or other. Runs of one class are words, with these exceptions: the
    last character of a white-space run inside a text goes its own way, and if it is a blank it begins the next word;
    an apostrophe that begins a word and stands before one of the contractions makes a word with it.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    OTHER, LETTER, NUMBER, SPACE = range(4)

    def __init__(self) -> None:
        import regex

        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        self.kind = np.zeros(0x110000, np.uint8)
        for k, pattern in ((self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+"), (self.SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                self.kind[ord(m[0][0]) : ord(m[0][-1]) + 1] = k
        self.ascii = np.zeros(256, np.uint8)
        self.ascii[:128] = self.kind[:128]

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        kind = self.ascii[data]
        for low, high, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
            lead = np.flatnonzero((data >= low) & (data < high))
            if len(lead):
                code = (data[lead] & (0xFF >> (size + 1))).astype(np.int64)
                for j in range(1, size):
                    code = code << 6 | data[lead + j] & 0x3F
                of = self.kind[code]
                for j in range(size):
                    kind[lead + j] = of
        return kind

    def spans(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words begin and end, and each text's first word."""
        data, offsets = chunk.data, chunk.offsets
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        kind = self.kinds(data)
        edge = np.zeros(n + 1, bool)  # a text begins or ends here
        edge[offsets] = True
        begins = edge[:n].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        # The last character of a white-space run that the text goes on after.
        run_end = np.flatnonzero((kind[:-1] == self.SPACE) & (kind[1:] != self.SPACE) & ~edge[1:n])
        if len(run_end):
            last = run_end.copy()
            while (inside := (data[last] & 0xC0) == 0x80).any():
                last[inside] -= 1
            begins[last] = True
            blank = data[run_end] == 32
            begins[run_end[blank] + 1] = False
        # Contractions.
        tick = np.flatnonzero((data == 39) & begins[:n])
        if len(tick):
            padded = np.concatenate((data, np.zeros(3, np.uint8)))
            room = offsets[np.searchsorted(offsets, tick, "right")] - tick - 1
            a, b = padded[tick + 1], padded[tick + 2]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (room >= 1)
            two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (room >= 2)
            for hit, size in ((one, 1), (two & ~one, 2)):
                at = tick[hit]
                begins[at + 1] = False
                after = at + 1 + size
                go_on = after[after < n]
                # What follows the contraction begins a word, unless it is the blank before one (then it does already).
                begins[go_on] = True
        start = np.flatnonzero(begins)
        return start, np.append(start[1:], n), np.searchsorted(start, offsets)


class Vocabulary:
    """Ranks of byte strings from a tiktoken file, with a table from pairs of tokens to the rank of their merge."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.splitter = ArraySplitter() if pattern == ArraySplitter.PATTERN else RegexSplitter(pattern)
        self.bytes_of = dict(map(reversed, self.ranks.items()))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        keys = np.array(sorted(pairs), np.int64)
        size = 1 << (4 * max(1, len(keys))).bit_length()
        self._bits = np.uint64(64 - (size.bit_length() - 1))
        self._keys, self._ranks = self._hashed(keys, np.array([pairs[int(k)] for k in keys], np.int64), size)
        self.token_length = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.token_length[list(self.bytes_of)] = [len(x) for x in self.bytes_of.values()]
        self.token_begin = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of[r] for r in sorted(self.bytes_of)), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._bits).astype(np.int64)

    def _hashed(self, keys: np.ndarray, ranks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        table, values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = table[slot] < 0
            table[slot[free]] = keys[free]
            values[slot[free]] = ranks[free]
            left = table[slot] != keys
            values[slot[~left]] = ranks[~left]
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) & (size - 1)
        return table, values

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make; _NONE where they make none."""
        keys = a << 20 | b
        out = np.full(len(keys), _NONE, np.int64)
        at, slot = np.arange(len(keys)), self._slot(keys)
        while len(at):
            there = self._keys[slot]
            hit = there == keys[at]
            out[at[hit]] = self._ranks[slot[hit]]
            on = (there >= 0) & ~hit
            at, slot = at[on], (slot[on] + 1) & (len(self._keys) - 1)
        return out

    def alone(self, word: bytes) -> list[int]:
        """The tokens of one word, with a heap of its pairs."""
        tok = [int(self.byte_ids[b]) for b in word]
        nxt, prv = [*range(1, len(tok)), -1], [*range(-1, len(tok) - 1)]

        def rank(i: int) -> int | None:
            return self.ranks.get(self.bytes_of[tok[i]] + self.bytes_of[tok[nxt[i]]]) if nxt[i] >= 0 else None

        heap = [(r, i) for i in range(len(tok)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        gone = set()
        while heap:
            r, i = heapq.heappop(heap)
            if i in gone or rank(i) != r:
                continue
            j = nxt[i]
            gone.add(j)
            tok[i], nxt[i] = r, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for k in (i, prv[i]):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [t for i, t in enumerate(tok) if i not in gone]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The token ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words], np.int64)
        start = np.concatenate(([0], np.cumsum(length)))
        n = len(data)
        word = np.repeat(np.arange(len(words)), length)
        tok = self.byte_ids[data]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = length > 0
        nxt[start[1:][full] - 1] = -1
        prv[start[:-1][full]] = -1
        rank = np.full(n, _NONE, np.int64)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.merge_rank(tok[inner], tok[nxt[inner]])
        alive = np.ones(n, bool)
        single = np.zeros(len(words), bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            at = at[rank[at] < _NONE]
            if len(at):
                of = rank[at]
                order = np.argsort(of, kind="stable")
                at, of = at[order], of[order]
                cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
                for r, part in zip(of[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(part)

        post(inner)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[(rank[at] == r) & alive[at]]
            if len(lists) == 1:
                at = np.sort(at)
            if not len(at):
                continue
            right = nxt[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # as in aaa: of touching pairs the first, third ... merge
                touch = np.concatenate(([False], right[:-1] == at[1:]))
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(touch, 0, np.arange(len(at))))
                at = at[run % 2 == 0]
                right = nxt[at]
            tok[at] = r
            after = nxt[right]
            nxt[at] = after
            alive[right] = False
            rank[right] = _NONE
            on = after >= 0
            prv[after[on]] = at[on]
            touched = np.concatenate((at, prv[at][prv[at] >= 0]))
            touched = np.unique(touched) if len(touched) > len(at) else touched
            rank[touched] = _NONE
            pair = touched[nxt[touched] >= 0]
            rank[pair] = self.merge_rank(tok[pair], tok[nxt[pair]])
            early = pair[rank[pair] <= r]
            if len(early):
                single[word[early]] = True
            post(pair)
        ids = tok[alive].astype("<u4")
        ends = np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4
        raw, at, out = ids.tobytes(), 0, []
        for to in ends.tolist():
            out.append(raw[at:to])
            at = to
        for k in np.flatnonzero(single).tolist():
            out[k] = np.array(self.alone(words[k]), "<u4").tobytes()
        return out

    def split(self, chunk: T.Chunk) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct words of a chunk, for each word of its texts the place in these, and each text's first word."""
        start, stop, first = self.splitter.spans(chunk)
        if not len(start):
            return [], np.zeros(0, np.int64), np.zeros(len(chunk.offsets), np.int64)
        _, at, which = np.unique(T.span_hashes(chunk.data, start, stop), return_index=True, return_inverse=True)
        same, _ = ragged(chunk.data, start[at][which], (stop - start)[at][which])
        if len(same) != len(chunk.data) or (same != chunk.data).any():  # two words of one hash
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(chunk.data[i:j].tobytes(), len(number)) for i, j in zip(start.tolist(), stop.tolist(), strict=True)], np.int64)
            return list(number), which, first
        raw = chunk.data.tobytes()
        return [raw[i:j] for i, j in zip(start[at].tolist(), stop[at].tolist(), strict=True)], which, first

    def joined(self, words: list[bytes], which: np.ndarray, first: np.ndarray, known: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk that was split, by the ids of its words, and where each text's begin."""
        own = [known[w] for w in words]
        length = np.array([len(x) // 4 for x in own], np.int64)
        ids, lengths = ragged(np.frombuffer(b"".join(own), "<u4"), (np.cumsum(length) - length)[which], length[which])
        return ids, np.concatenate(([0], np.cumsum(lengths)))[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, and where each text's begin."""
        out, lengths = ragged(self.token_bytes, self.token_begin[ids], self.token_length[ids])
        return out, np.concatenate(([0], np.cumsum(lengths)))[offsets]


def ragged(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of values, one after the other, and their lengths."""
    before = np.cumsum(length) - length
    return values[np.repeat(begin - before, length) + np.arange(int(length.sum()))], length


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary(path, pattern)
    return _loaded[path, pattern]


def _slices(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw, size = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
    return [bytes(raw[i * size : j * size]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _packed(docs: DataFrame) -> DataFrame:
    """(block, rows): the rows of docs by blocks of about BLOCK_BYTES of text, compressed. A block is named by its task and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, options = TaskContext.get().partitionId(), pa.ipc.IpcWriteOptions(compression="zstd")
        n = 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as to:
                for h in held:
                    to.write_batch(h)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | n]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

        for b in batches:
            for c in T.chunks(b.column("text"), BLOCK_BYTES):
                held.append(b.slice(c.first, len(c.offsets) - 1))
                size += len(c.data)
                if size >= BLOCK_BYTES:
                    yield out()
                    n, size = n + 1, 0
                    held.clear()
        if held:
            yield out()

    return docs.mapInArrow(lean(run), "block long, rows binary")


def _texts(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(rows)).read_all()


def _by_bucket(words: set[bytes], buckets: int) -> dict[int, list[bytes]]:
    """The words of each bucket, in order: the same for the task that asks and the one that has the answer."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(words):
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return out


def _lengths(x: list[bytes]) -> bytes:
    return np.array([len(w) for w in x], "<u4").tobytes()


def _asked(blocks: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """(bucket, block, words, lengths): each block's distinct words by bucket, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            for block, rows in zip(b.column("block").to_pylist(), b.column("rows"), strict=True):
                words: set[bytes] = set()
                for c in T.chunks(_texts(rows.as_py()).column("text"), CHUNK_BYTES):
                    words.update(v.split(c)[0])
                by = _by_bucket(words, buckets)
                columns = [pa.array(list(by), pa.int32()), pa.array([block] * len(by), pa.int64()), pa.array([b"".join(x) for x in by.values()], pa.binary()), pa.array([_lengths(x) for x in by.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "words", "lengths"])

    return blocks.mapInArrow(lean(run), "bucket int, block long, words binary, lengths binary")


def _answers(asked: DataFrame, path: str, pattern: str) -> DataFrame:
    """(block, bucket, sum, ids, lengths): the ids of the words asked for. Each distinct word of all texts is in one bucket and is replayed
    there once, whatever the number of blocks that ask; sum is the words' checksum."""

    def run(t: pa.Table) -> pa.Table:
        v = vocabulary(path, pattern)
        lists = []
        for words, lengths in zip(t["words"].to_pylist(), t["lengths"].to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
            lists.append([words[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)])
        distinct = list(dict.fromkeys(w for x in lists for w in x))
        known: dict[bytes, bytes] = {}
        at = 0
        while at < len(distinct):  # REPLAY_BYTES of words share an index
            to, size = at, 0
            while to < len(distinct) and (size < REPLAY_BYTES or to == at):
                size += len(distinct[to])
                to += 1
            known.update(zip(distinct[at:to], v.replay(distinct[at:to]), strict=True))
            at = to
        release_memory()
        own = [[known[w] for w in x] for x in lists]
        sums = [zlib.crc32(w) for w in t["words"].to_pylist()]
        return pa.table({"block": t["block"], "bucket": t["bucket"], "sum": pa.array(sums, pa.int64()), "ids": pa.array([b"".join(x) for x in own], pa.binary()), "lengths": pa.array([_lengths(x) for x in own], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, sum long, ids binary, lengths binary")


def _coded(docs: DataFrame, path: str, pattern: str, schema: str | S.StructType, made: Callable[[Vocabulary, pa.Table, list[tuple[np.ndarray, np.ndarray]]], pa.Table]) -> DataFrame:
    """What made() gives for each block of docs and the ids of its texts, chunk by chunk."""
    n = partitions(docs)
    blocks, buckets = _packed(docs).repartition(n, "block"), 4 * n
    answers = _answers(_asked(blocks, path, pattern, buckets), path, pattern)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v = vocabulary(path, pattern)
        got = {bucket: (s, ids, lengths) for bucket, s, ids, lengths in zip(*(right[c].to_pylist() for c in ("bucket", "sum", "ids", "lengths")), strict=True)}
        out = []
        for rows in left["rows"]:
            table = _texts(rows.as_py())
            chunks = [v.split(c) for c in T.chunks(table.column("text"), CHUNK_BYTES)]
            known: dict[bytes, bytes] = {}
            for bucket, words in _by_bucket({w for c in chunks for w in c[0]}, buckets).items():
                s, ids, lengths = got.get(bucket, (-1, b"", b""))
                if s != zlib.crc32(b"".join(words)):  # a block that came out otherwise when it was read again
                    known.update(zip(words, v.replay(words), strict=True))
                    continue
                ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
                known.update(zip(words, [ids[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
            out.append(made(v, table, [v.joined(*c, known) for c in chunks]))
            release_memory()
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with _ids (binary, little-endian unsigned 32-bit token ids of text); a column of docs of that name gives way.

    Null and empty texts have no ids; repeated rows are encoded alike; an empty table gives no rows.
    path names the file of ranks, which is on every machine; pattern is the regular expression that splits texts.
    """
    docs = without(docs, "_ids")
    schema = S.StructType([*docs.schema.fields, S.StructField("_ids", S.BinaryType())])

    def made(v: Vocabulary, t: pa.Table, coded: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        return t.append_column("_ids", pa.array([x for c in coded for x in _slices(*c)], pa.binary()))

    return _coded(docs, path, pattern, schema, made)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded with _decoded (binary), the bytes that _ids stands for (none where it is null); a column of that name gives way."""
    encoded = without(encoded, "_decoded")
    schema = S.StructType([*encoded.schema.fields, S.StructField("_decoded", S.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            out = [v.decode(ids, np.array([0, len(ids)]))[0].tobytes() for ids in (np.frombuffer(x or b"", "<u4") for x in b.column("_ids").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "_decoded"])

    return encoded.mapInArrow(lean(run), schema)


def bpe_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs; ids and bytes are not kept.

    Null and empty texts have no tokens and the hashes of nothing. Every row counts, with a null or repeated id too.
    """

    def made(v: Vocabulary, t: pa.Table, coded: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        sha = lambda values, at: [hashlib.sha256(x).hexdigest() for x in _slices(values, at)]
        count = [n for _, at in coded for n in np.diff(at).tolist()]
        ids_hash = [x for c in coded for x in sha(*c)]
        text_hash = [x for c in coded for x in sha(*v.decode(*c))]
        return pa.table({"doc_id": t["doc_id"], "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())})

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _coded(few, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", made)
