"""Communities by modularity: Louvain's moves and contractions over packed arrays, with whole-number weights so that every run gives the same.

A round lets a part of the nodes (by the crc32 of id and level) move at once to the neighbouring community of the highest
gain; the others stay, so that two neighbours do not change places. A round whose moves would lower the modularity is
taken back and the parts are made smaller. Then each community becomes a node, with the weights between communities as
edges, and the next level begins. Modularity never falls from level to level.

Ids are numbers in the order of their names. Nodes are dealt over blocks by a hash; what a block says to another goes as one
packet of arrays, which Spark shuffles by block. A block's edges are written once a level, sorted by who is to hear of them. In a
round each block asks for the weights of its nodes' communities, tells the neighbours community and weight, and from
what it hears knows each node's best move, the modularity and so whether the round stands; no table has a row for each edge.

With n communities of total weights t and inner weights w of a graph whose degrees sum to m2, modularity is
sum(m2 * w - t * t) / (m2 * m2). All is in whole numbers; where 64 bits could overflow they are Python's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import of_types
from lodestone.operators.propagation import BLOCK_BYTES, _all, _block, _by_block, _chunks, _opened, _packed, _starts
from lodestone.session import dropped, input_bytes, materialised

#: Parts that the nodes are dealt over at first and at last.
PARTS, MOST_PARTS = 2, 4
#: Rows of links for each block of a level after the first.
BLOCK_ROWS = 1 << 21

#: Kinds of packets, rows in whole numbers: neighbours (target, place of the source in its block, weight), nodes (id, community,
#: degree, loop, crc of the name, best community), answers (community, value, more), messages, edges (a, b, weight), crcs (id, crc), names (id, name).
NEAR, NODES, ANSWER, TOLD, EDGES, CRCS, NAMES = range(7)
ROWS = "block int, kind int, packet binary"
#: With nodes: inner weight, sum of degree times community's weight, nodes that would move by part, distinct links.
STATE = f"{ROWS}, inner decimal(38,0), squares decimal(38,0), moves array<long>, links long"
CRC = np.array([(lambda c: [c := c >> 1 ^ (0xEDB88320 if c & 1 else 0) for _ in range(8)][-1])(i) for i in range(256)], np.int64)


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _graph(edges: DataFrame, predicates: list[str] | None, weight: str | None) -> DataFrame:
    """(a, b, w): undirected, each edge from both ends, parallel edges together; a loop counts twice, as (a, a)."""
    own = _weighed(edges, predicates, weight)
    return own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def _weighed(edges: DataFrame, predicates: list[str] | None, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    return of_types(edges, predicates).where("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w")).where("w > 0")


def _quality(graph: DataFrame, places: DataFrame, m2: int) -> Decimal:
    """Modularity times m2 * m2 of places (id, c, k)."""
    at = lambda end: places.select(F.col("id").alias(end), F.col("c").alias(f"c_{end}"))
    wide = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)")
    inner = graph.join(at("a"), "a").join(at("b"), "b").where("c_a = c_b").agg(wide(F.sum("w")).alias("w"), wide(F.lit(0)).alias("s"))
    rest = places.groupBy("c").agg(F.sum("k").alias("t")).agg(wide(F.lit(0)).alias("w"), wide(F.sum(_wide(F.col("t")) * _wide(F.col("t")))).alias("s"))
    w, s = inner.unionByName(rest).agg(F.sum("w"), F.sum("s")).first()
    return Decimal(m2) * w - s


def modularity(edges: DataFrame, communities: DataFrame, predicates: list[str] | None = None, weight: str | None = None) -> float:
    """Modularity of communities (id, community) on the edges; 0 where there is no edge."""
    graph = materialised(_graph(edges, predicates, weight))
    k = graph.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    m2 = k.agg(F.sum("k")).first()[0]
    places = k.join(communities, "id").select("id", F.col("community").alias("c"), "k")
    return float(_quality(graph, places, m2) / (Decimal(m2) * m2)) if m2 else 0.0


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"block": pd.Series([r[0] for r in rows], dtype="int32"), "kind": pd.Series([r[1] for r in rows], dtype="int32"), "packet": pd.Series([r[2] for r in rows], dtype=object)})


def _batches(rows: Iterator[tuple]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["block", "kind", "packet"])


def _of(rows: pd.DataFrame, kind: int) -> np.ndarray | None:
    """The packets of a kind as one matrix."""
    return _all(rows["packet"][rows["kind"] == kind])


def _turn(crc: np.ndarray, level: int) -> np.ndarray:
    """crc32 of what crc is of, with the level's digits after it."""
    c = crc ^ 0xFFFFFFFF
    for digit in str(level).encode():
        c = CRC[(c ^ digit) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def _placed(nodes: np.ndarray, level: int, parts: int, turn: int | None) -> np.ndarray:
    """The communities of a block's nodes when those whose turn it is have moved."""
    _, c, _, _, crc, to = nodes
    return c if turn is None else np.where(_turn(crc, level) % parts == turn, to, c)


def _order(place: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How to sort by place, then b: as one number where that holds both."""
    bits = int(b.max()).bit_length() if len(b) else 0
    if len(b) and b.min() >= 0 and bits + int(place.max()).bit_length() < 64:
        return np.argsort(place << bits | b)
    return np.lexsort((b, place))


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct a; rows (place of a in them, b, w) sorted, those with the same a and b as one."""
    ids, place = np.unique(a, return_inverse=True)
    order = _order(place, b)
    place, b = place[order], b[order]
    at = _starts(place, b)
    return ids, place[at], b[at], np.add.reduceat(w[order], at)


def _looked_up(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    order = np.argsort(table[0], kind="stable")
    return table[1:, order[np.searchsorted(table[0], keys, sorter=order)]]


def _level(edges: DataFrame, blocks: int) -> DataFrame:
    """NEAR and NODES of EDGES, which have both directions, and CRCS: each node a community by itself."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids, place, b, w = _summed(*_of(rows, EDGES))
        begin, block, other = _starts(place), int(rows["block"].iloc[0]), ids[place] != b
        k, loop = np.add.reduceat(w, begin), np.add.reduceat(np.where(other, 0, w), begin)
        crcs = _of(rows, CRCS)
        crc = np.zeros(len(ids), np.int64) if crcs is None else _looked_up(ids, crcs)[0]
        b, place, w = b[other], place[other], w[other]
        order = np.argsort(b, kind="stable")
        near = [(block, NEAR, p) for _, p in _by_block(blocks, b[order], place[order], w[order])]
        return _frame([*near, (block, NODES, _packed(ids, ids, k, loop, crc, ids))])

    return materialised(edges.groupBy("block").applyInPandas(build, ROWS))


def _asked(nodes: DataFrame, blocks: int, value: Callable[[np.ndarray], tuple[np.ndarray, ...]], how: Callable[[np.ndarray, np.ndarray], np.ndarray], more: Callable | None = None) -> DataFrame:
    """ANSWER packets to each block for the communities of its nodes: value(nodes) gives (community, columns...), how(sorted columns,
    begins) puts those of a community together. more(answer) gives rows besides.
    """

    def ask(batches):
        for b in batches:
            for block, packet in zip(b.column("block").to_pylist(), b.column("packet"), strict=True):
                rows = list(_by_block(blocks, *value(_opened(packet.as_py()))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "asker", "packet"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        each = [_opened(p) for p in rows["packet"]]
        every = np.concatenate(each, axis=1)
        every = every[:, np.lexsort((every[1], every[0]))]
        begin = _starts(every[0])
        known = np.vstack([every[0][begin], how(every[1:], begin)])
        out = [(asker, ANSWER, _packed(m[0], *known[1:, np.searchsorted(known[0], m[0])])) for asker, m in zip(rows["asker"], each, strict=True)]
        return _frame([*out, *(more(known) if more else ())])

    return nodes.mapInArrow(ask, "block int, asker int, packet binary").groupBy("block").applyInPandas(answer, ROWS)


def _told(rows: pd.DataFrame, blocks: int, values: np.ndarray) -> list[tuple]:
    """TOLD packets (target, weight, values of the source) to each block that has neighbours of this one."""
    out = []
    for packet in rows["packet"][rows["kind"] == NEAR]:
        target, place, w = _opened(packet)
        out.append((int(_block(target[:1], blocks)[0]), TOLD, _packed(target, w, *values[:, place], level=0)))
    return out


def _state(near: DataFrame, nodes: DataFrame, blocks: int, level: int, m2: int, parts: int = PARTS, turn: int | None = None) -> DataFrame:
    """NODES after the moves of a turn (None: none yet), with what is best for each next, and figures of the whole (STATE)."""
    number = np.int64 if m2 < 3_000_000_000 else object  # m2 * m2 is the largest that comes up

    def weights(n: np.ndarray) -> tuple[np.ndarray, ...]:
        c = _placed(n, level, parts, turn)
        order = np.argsort(c, kind="stable")
        begin = _starts(c[order])
        return c[order][begin], np.add.reduceat(n[2][order], begin)

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        nodes_ = _of(rows, NODES)
        c = _placed(nodes_, level, parts, turn)
        values = np.vstack([c, _looked_up(c, _of(rows, ANSWER))])
        own = (int(rows["block"].iloc[0]), TOLD, _packed(nodes_[0], np.zeros_like(c), *values, level=0))
        return _frame([own, *_told(rows, blocks, values)])

    def hear(rows: pd.DataFrame) -> pd.DataFrame:
        nodes_ = _of(rows, NODES)
        ids, _, k, loop, crc, _ = nodes_
        now = _placed(nodes_, level, parts, turn)
        a, w, c, t = _of(rows, TOLD)
        place = np.searchsorted(ids, a)
        order = _order(place, c)
        place, c = place[order], c[order]
        at = _starts(place, c)
        w, t, place, c = np.add.reduceat(w[order], at), t[order][at], place[at], c[at]
        own = c == now[place]
        kk, tt = k[place].astype(number), t.astype(number)
        gain = m2 * w.astype(number) - kk * (tt - np.where(own, kk, 0))
        begin = _starts(place)
        most = np.maximum.reduceat(gain, begin)
        best = np.flatnonzero(gain == np.repeat(most, np.diff(begin, append=len(place))))
        best = best[_starts(place[best])]  # the smallest community of the highest gain, as they are sorted
        to = np.where(most > gain[own], c[best], now)
        moves = np.bincount(_turn(crc, level)[to != now] % MOST_PARTS, minlength=MOST_PARTS)
        figures = {"inner": Decimal(int(w[own].sum() + loop.sum())), "squares": Decimal(int((kk[own] * tt[own]).sum())), "moves": moves, "links": len(c)}
        return _frame([(int(rows["block"].iloc[0]), NODES, _packed(ids, now, k, loop, crc, to))]).assign(**{x: [v] for x, v in figures.items()})

    nodes = nodes.select("block", "kind", "packet")
    answers = _asked(nodes, blocks, weights, lambda columns, begin: np.add.reduceat(columns, begin, axis=1))
    told = near.unionByName(nodes).unionByName(answers).groupBy("block").applyInPandas(tell, ROWS)
    return materialised(told.unionByName(nodes).groupBy("block").applyInPandas(hear, STATE))


def _standing(state: DataFrame, m2: int) -> tuple[Decimal, list[int], int]:
    """Modularity times m2 * m2, how many nodes would move by part, and how many links there are."""
    inner, squares, links, *moves = state.agg(F.sum("inner"), F.sum("squares"), F.sum("links"), *[F.sum(F.col("moves")[i]) for i in range(MOST_PARTS)]).first()
    return Decimal(m2) * inner - squares, moves, links


def _contracted(near: DataFrame, nodes: DataFrame, blocks: int, new_blocks: int) -> DataFrame:
    """EDGES and CRCS of the communities, each by its smallest id, dealt over new_blocks, and NAMES: that id of each node."""

    def smallest(n: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(n[1], kind="stable")
        begin = order[_starts(n[1][order])]  # ids are sorted
        return n[1][begin], n[0][begin], n[4][begin]

    def crcs(known: np.ndarray) -> Iterator[tuple]:
        _, name, crc = known
        order = np.argsort(name)
        return ((block, CRCS, p) for block, p in _by_block(new_blocks, name[order], crc[order]))

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        ids, c, *_ = nodes_ = _of(rows, NODES)
        block, name = int(rows["block"].iloc[0]), _looked_up(c, _of(rows, ANSWER))[0]
        return _frame([(block, NAMES, _packed(ids, name)), (block, TOLD, _packed(ids, nodes_[3], name)), *_told(rows, blocks, name[None])])

    def hear(rows: pd.DataFrame) -> pd.DataFrame:
        names, (a, w, other) = _of(rows, NAMES), _of(rows, TOLD)
        one = _looked_up(a, names)[0]
        ids, place, other, w = _summed(one[w > 0], other[w > 0], w[w > 0])
        names = [(int(rows["block"].iloc[0]), NAMES, p) for p in rows["packet"][rows["kind"] == NAMES]]
        return _frame([*names, *[(b, EDGES, p) for b, p in _by_block(new_blocks, ids[place], other, w)]])

    nodes = nodes.select("block", "kind", "packet")
    answers = materialised(_asked(nodes, blocks, smallest, lambda columns, begin: columns[:, begin], crcs))
    told = near.unionByName(nodes).unionByName(answers.where(F.col("kind") == ANSWER)).groupBy("block").applyInPandas(tell, ROWS)
    out = materialised(told.groupBy("block").applyInPandas(hear, ROWS).unionByName(answers.where(F.col("kind") == CRCS)))
    dropped(answers)
    return out


def _rows(packets: DataFrame, first: str, second: str) -> DataFrame:
    """The first two columns of packets as rows."""

    def unpack(batches):
        for b in batches:
            for p in b.column("packet"):
                columns = _opened(p.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1])], [first, second])

    return packets.mapInArrow(unpack, f"{first} long, {second} long")


def _found(pairs: DataFrame, names: Callable[[DataFrame], DataFrame], blocks: int, max_levels: int, max_rounds: int, tolerance: float) -> DataFrame:
    """(id, first) of pairs (a, b, w), w over 0: each end and the smallest id of its community. names gives (id, name) of (id)."""

    def deal(batches):
        for a, b, w in _chunks(batches):
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            order = np.argsort(a)
            yield _batches((block, EDGES, p) for block, p in _by_block(blocks, a[order], b[order], np.concatenate([w, w])[order]))

    def crcs(batches):
        for ids, crc in _chunks(batches):
            order = np.argsort(ids)
            yield _batches((block, CRCS, p) for block, p in _by_block(blocks, ids[order], crc[order]))

    def with_crcs(rows: pd.DataFrame) -> pd.DataFrame:
        n = _of(rows, NODES)
        n[4] = _looked_up(n[0], _of(rows, CRCS))[0]
        return _frame([(int(rows["block"].iloc[0]), NODES, _packed(*n))])

    def degrees(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([Decimal(int(_opened(p.as_py())[2].sum())) for p in b.column("packet")], pa.decimal128(38, 0))], ["k"])

    here = _level(pairs.mapInArrow(deal, ROWS), blocks)
    of = lambda df, kind: df.where(F.col("kind") == kind)
    m2 = int(of(here, NODES).mapInArrow(degrees, "k decimal(38,0)").agg(F.sum("k")).first()[0] or 0)
    ids = _rows(of(here, NODES), "id", "c").select("id")
    marks = names(ids).select("id", F.crc32(F.concat("name", F.lit(":")).cast("binary")).alias("crc"))
    nodes = materialised(of(here, NODES).unionByName(marks.mapInArrow(crcs, ROWS)).groupBy("block").applyInPandas(with_crcs, ROWS))
    least, steps = Decimal(m2) * m2 * Decimal(str(tolerance)), []
    for level in range(max_levels if m2 else 0):
        near = of(here, NEAR)
        state = _state(near, nodes, blocks, level, m2)
        (quality, moves, links), parts, still, begun = _standing(state, m2), PARTS, 0, False
        for round_ in range(max_rounds):
            turn = round_ % parts
            if not sum(moves[turn::parts]):
                still += 1
            else:
                new = _state(near, state, blocks, level, m2, parts, turn)
                better, new_moves, new_links = _standing(new, m2)
                if better > quality:  # a round that gains less than the tolerance counts as still
                    still = still + 1 if better - quality < least else 0
                    dropped(state)
                    state, quality, moves, links, begun = new, better, new_moves, new_links, True
                else:
                    dropped(new)
                    if parts >= MOST_PARTS:
                        break
                    parts, still = 2 * parts, 0
            if still >= parts:
                break
        if not begun:
            dropped(state)
            break
        new_blocks = max(8, min(blocks, -(-links // BLOCK_ROWS)))
        steps.append(_contracted(near, state, blocks, new_blocks))
        dropped(here, nodes, state)
        blocks = new_blocks
        here = _level(steps[-1].where(F.col("kind").isin(EDGES, CRCS)), blocks)
        nodes = of(here, NODES)
    if not steps:
        return ids.select("id", F.col("id").alias("first"))
    *before, found = [_rows(of(s, NAMES), "id", "first") for s in steps]
    for names_ in reversed(before):
        found = materialised(found)
        found = names_.withColumnRenamed("first", "at").join(found.withColumnRenamed("id", "at"), "at").select("id", "first")
    return found


def louvain(nodes: DataFrame, edges: DataFrame, predicates: list[str] | None = None, weight: str | None = None, max_levels: int = 10, max_rounds: int = 8, tolerance: float = 1e-3, code: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None) -> DataFrame:
    """(id, community) for each node; community is the smallest id in it. A level ends when no part gains tolerance any more.

    Edges are undirected; weight names a column of whole numbers (parallel edges add up; without it each counts 1). Edges
    with a null end, of weight 0 or less, and ends that are no node have no part in the result. A node without edges is a
    community by itself. code makes numbers (long) of ids that keep their order, and ids of these numbers; without it the
    ids are numbered first, which joins the edges twice. A task holds a block: about BLOCK_BYTES of input, or the edges of one node if those are more.
    """
    blocks = max(8, -(-input_bytes(edges) // BLOCK_BYTES))
    own = _weighed(edges, predicates, weight)
    if code:
        number, name = code
        found = _found(own.select(number(F.col("a")).alias("a"), number(F.col("b")).alias("b"), "w"), lambda ids: ids.select("id", name(F.col("id")).alias("name")), blocks, max_levels, max_rounds, tolerance)
        found = found.select("id", F.when(F.col("first") == F.col("id"), F.lit(None).cast("string")).otherwise(name(F.col("first"))).alias("community"))  # a node that stands for itself has its own id
        return nodes.select(number(F.col("id")).alias("_n"), F.col("id").alias("_id")).join(found, F.col("_n") == F.col("id"), "left").select(F.col("_id").alias("id"), F.coalesce("community", "_id").alias("community"))
    own = materialised(own)
    ends = own.select(F.col("a").alias("name")).unionByName(own.select(F.col("b").alias("name"))).distinct().repartitionByRange("name").sortWithinPartitions("name")
    codes = materialised(ends.select("name", F.monotonically_increasing_id().alias("id")))  # in the order of names
    end = lambda e: codes.select(F.col("name").alias(e), F.col("id").alias(f"id_{e}"))
    pairs = own.join(end("a"), "a").join(end("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "w")
    found = _found(pairs, lambda _: codes, blocks, max_levels, max_rounds, tolerance)
    found = found.join(codes, "id").select(F.col("name").alias("id"), "first").join(codes.select(F.col("id").alias("first"), F.col("name").alias("community")), "first")
    return nodes.select("id").join(found.select("id", "community"), "id", "left").select("id", F.coalesce("community", "id").alias("community"))
