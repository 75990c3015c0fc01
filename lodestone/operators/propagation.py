"""Label propagation over packed messages: each round every node tells its neighbours its label, and takes the commonest it hears.

Nodes are dealt over blocks by a hash of their number. A block's neighbours are written once as packed arrays; in a round they
meet the block's labels, and what a block says to another goes as one packet: sorted by node and label, equal votes
counted together. Spark shuffles the packets by block; a task opens those of one block at a time. A row for each edge and
round would be shuffled three times and be several times as long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import dropped, input_bytes, materialised

#: Bytes of input files for each block; tables of edges have about two million ends in them.
BLOCK_BYTES = 8 << 20
#: Rows that a task collects before it packs them.
CHUNK = 1 << 20

PACKETS = "block int, packet binary"


def _packed(*columns: np.ndarray, level: int = 1) -> bytes:
    """Columns of whole numbers of one length as bytes: differences of the first (sorted), others as they are.

    Each byte's place is by itself, and only the places that a column needs: a first byte says how many columns, then one each how many places.
    """
    columns = (np.diff(columns[0], prepend=np.int64(0)), *columns[1:])
    places = [8 if c.min() < 0 else -(-int(c.max()).bit_length() // 8) for c in columns]
    planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T[:n]).tobytes() for c, n in zip(columns, places, strict=True)]
    return bytes([len(columns), *places]) + len(columns[0]).to_bytes(4, "little") + zlib.compress(b"".join(planes), level)


def _opened(packet: bytes) -> np.ndarray:
    """The columns of _packed() as rows of a matrix."""
    k = packet[0]
    places, n = packet[1 : k + 1], int.from_bytes(packet[k + 1 : k + 5], "little")
    raw, at = np.frombuffer(zlib.decompress(memoryview(packet)[k + 5 :]), np.uint8), 0
    out = np.zeros((k, n, 8), np.uint8)
    for i, m in enumerate(places):
        out[i, :, :m] = raw[at : at + m * n].reshape(m, n).T
        at += m * n
    out = out.view("<i8")[:, :, 0]
    out[0] = np.cumsum(out[0])
    return out


def _all(packets: pd.Series) -> np.ndarray | None:
    return np.concatenate([_opened(p) for p in packets], axis=1) if len(packets) else None


def _block(nodes: np.ndarray, blocks: int) -> np.ndarray:
    return (((nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for c in sorted_:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _merged(how: np.ufunc, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by a and b, those with the same a and b as one with their w put together; none is negative."""
    if not len(a):
        return a, b, w
    for_b, for_w = int(b.max()).bit_length(), int(w.max()).bit_length()
    if a.min() < 0 or b.min() < 0 or int(a.max()).bit_length() + for_b > 63:
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
    elif int(a.max()).bit_length() + for_b + for_w > 63:
        key = a << for_b | b
        order = np.argsort(key)
        key, w = key[order], w[order]
        a, b = key >> for_b, key & ((1 << for_b) - 1)
    else:  # all three in one number
        key = np.sort((a << for_b | b) << for_w | w)
        key, w = key >> for_w, key & ((1 << for_w) - 1)
        a, b = key >> for_b, key & ((1 << for_b) - 1)
    at = _starts(a, b)
    return a[at], b[at], how.reduceat(w, at)


def _by_block(blocks: int, a: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(block, packet) of rows that are sorted by their node a."""
    block = _block(a, blocks)
    order = np.argsort(block.astype(np.uint16) if blocks < 1 << 16 else block, kind="stable")
    block, cols = block[order], [c[order] for c in (a, *more)]
    ends = [*_starts(block), len(block)] if len(block) else []
    for i, j in zip(ends, ends[1:], strict=False):
        yield int(block[i]), _packed(*[c[i:j] for c in cols])


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "packet"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        if n >= CHUNK:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _neighbours(nodes: DataFrame, edges: DataFrame, blocks: int) -> DataFrame:
    """(block, packet): node, other, votes of each node's neighbours, each once, and of each of nodes to itself."""

    def deal(batches):
        for a, b, kind in _chunks(batches):
            other = kind == 1
            yield _batch(list(_by_block(blocks, *_merged(np.bitwise_or, np.concatenate([a, b[other]]), np.concatenate([b, a[other]]), np.concatenate([kind, kind[other]])))))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, kind = _merged(np.bitwise_or, *_all(rows["packet"]))
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "packet": [_packed(a, b, (kind & 1) + (kind >> 1))]})

    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("kind")).where("a is not null and b is not null")
    pairs = pairs.unionByName(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(2).cast("long").alias("kind")))
    return materialised(pairs.mapInArrow(deal, PACKETS).groupBy("block").applyInPandas(gather, PACKETS))


def _round(near: DataFrame, labels: DataFrame, blocks: int) -> DataFrame:
    """(block, packet): node, label after one round."""

    def tell(near_: pd.DataFrame, labels_: pd.DataFrame) -> pd.DataFrame:
        if not len(near_) or not len(labels_):
            return pd.DataFrame({"block": pd.Series(dtype="int32"), "packet": pd.Series(dtype=object)})
        (node, other, votes), (known, label) = _all(near_["packet"]), _all(labels_["packet"])
        order = np.argsort(known, kind="stable")
        known, label = known[order], label[order]
        at = np.minimum(np.searchsorted(known, node), len(known) - 1)
        has = known[at] == node
        return pd.DataFrame(list(_by_block(blocks, *_merged(np.add, other[has], label[at[has]], votes[has]))), columns=["block", "packet"])

    def vote(rows: pd.DataFrame) -> pd.DataFrame:
        node, label, n = _merged(np.add, *_all(rows["packet"]))
        begin = _starts(node)
        most = np.flatnonzero(n == np.repeat(np.maximum.reduceat(n, begin), np.diff(begin, append=len(n))))
        first = most[_starts(node[most])]  # the smallest label of the most votes, as labels are sorted
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "packet": [_packed(node[first], label[first])]})

    told = near.groupBy("block").cogroup(labels.groupBy("block")).applyInPandas(tell, PACKETS)
    return materialised(told.groupBy("block").applyInPandas(vote, PACKETS))


def propagated(nodes: DataFrame, edges: DataFrame, rounds: int, blocks: int | None = None) -> DataFrame:
    """(id, community) after label propagation over nodes (id long, name) and edges (src long, dst long); community is a name.

    Labels are the nodes' names, the smallest of ties. Edges are undirected and count once for each two nodes, a node counts its own
    label too. An end that is no node takes part from when it hears a label. Null ids have no part. A task holds the edges
    of one block: about BLOCK_BYTES of input, or the edges of one node if those are more.
    """
    blocks = blocks or max(8, -(-input_bytes(edges) // BLOCK_BYTES))
    ranked = nodes.where("id is not null").select("id", "name").repartitionByRange("name").sortWithinPartitions("name")
    ranked = materialised(ranked.select("id", "name", F.monotonically_increasing_id().alias("at")).withColumn("part", F.expr("shiftright(at, 33)")))
    before = ranked.groupBy("part").agg((F.max("at") + 1).alias("end")).select("part", F.expr("end - shiftleft(part, 33)").alias("n"))  # a row for each task
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.expr("shiftleft(part, 33)")).alias("shift"))
    ranked = ranked.join(F.broadcast(before), "part").select("id", "name", (F.col("at") + F.col("shift")).alias("label"))

    def pack(batches):
        for node, label in _chunks(batches):
            order = np.argsort(node, kind="stable")
            yield _batch(list(_by_block(blocks, node[order], label[order])))

    def unpack(batches):
        for b in batches:
            for p in b.column(1):
                node, label = _opened(p.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["id", "label"])

    near = _neighbours(ranked.select("id"), edges, blocks)
    labels = ranked.select("id", "label").mapInArrow(pack, PACKETS)
    for _ in range(rounds):
        new = _round(near, labels, blocks)
        dropped(labels)
        labels = new
    dropped(near)
    found = labels.mapInArrow(unpack, "id long, label long")  # far more bytes than its packets: too many to be broadcast by their size
    return found.join(ranked.select("label", F.col("name").alias("community")).hint("merge"), "label").select("id", "community")
