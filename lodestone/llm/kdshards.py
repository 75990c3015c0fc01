"""Documents into shards of near equal bytes by a k-d tree over their metadata.

The tree begins with all documents and all shards. A node that has several shards is split along its widest dimension
(its range as a share of the corpus's range) at the weighted quantile that leaves both sides the bytes their shards are
to hold; a node with one shard is a leaf. All nodes of a level are worked on together: one aggregation gives their ranges,
and a few histograms of bytes, each over one bin of the one before, find the cuts. Only these histograms (at most
``shards * BINS`` rows) reach the driver; every document counts in each of them.

A coordinate is a dimension scaled to 20 bits, followed by 32 bits of a hash of the text, so that equal texts stay
together and ties can be cut. Only a group of equal texts with more bytes than a whole shard is to hold cannot stay
together; its rows are told apart by id. There are fewer such groups than shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import saved, set_aside, without

BINS = 512
TIE_BITS, DIM_BITS = 32, 20
#: A cut is fine enough when the bin it falls in holds so small a part of the node.
FINE = 0.001
#: Parts of a shard whose rows are numbered separately.
SLOT_PARTS = 256


@dataclass
class Node:
    shards: int
    dim: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def text_dims(text: Column) -> list[Column]:
    """Size, share of multi-byte characters and mean line length, each scaled to 0..1; a null text is empty."""
    t = F.coalesce(text, F.lit(""))
    size = F.octet_length(t)
    lines = size - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return [F.log2(size + F.lit(1.0)) / 31, (size - F.char_length(t)) / F.greatest(size, F.lit(1)), F.log2(size / lines + F.lit(1.0)) / 31]


def measured(docs: DataFrame, dims: list[Column] | None = None) -> DataFrame:
    """docs with _size, _crc, _h (hash of the text) and _d0, _d1, ... (scaled dimensions); one pass, no shuffle."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    scaled = {f"_d{i}": F.floor(F.least(F.greatest(F.coalesce(d, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * ((1 << DIM_BITS) - 1)) for i, d in enumerate(dims or text_dims(F.col("text")))}
    return docs.withColumns({"_size": F.octet_length(raw).cast("long") + 16, "_crc": F.crc32(raw.cast("binary")), "_h": F.xxhash64(raw), **scaled})


def coordinates(n_dims: int, heavy: list[int]) -> list[Column]:
    by_id = F.xxhash64("_h", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    hashed = F.when(F.col("_h").isin(heavy), by_id).otherwise(F.col("_h")) if heavy else F.col("_h")
    tie = F.pmod(hashed, F.lit(1 << TIE_BITS))
    return [F.col(f"_d{i}") * (1 << TIE_BITS) + tie for i in range(n_dims)]


def place(node: Node, coords: list[Column], leaf) -> Column:
    """The tree as a column; leaf gives the value of a node without children."""
    if node.left is None:
        return F.lit(leaf(node))
    return F.when(coords[node.dim] < node.cut, place(node.left, coords, leaf)).otherwise(place(node.right, coords, leaf))


def grow(rows: DataFrame, n_dims: int, shards: int) -> tuple[Node, list[int]]:
    """The tree for rows (as from measured(), kept in a table) and the hashes of the groups larger than a shard."""
    total = rows.agg(F.sum("_size")).first()[0] or 0
    groups = rows.groupBy("_h").agg(F.sum("_size").alias("w"), F.count(F.lit(1)).alias("n"))
    heavy = [r["_h"] for r in groups.where((F.col("w") > total / shards) & (F.col("n") > 1)).select("_h").collect()]  # fewer than shards
    coords = coordinates(n_dims, heavy)
    root = Node(shards)
    level, spread = [root], None
    while level := [n for n in level if n.shards > 1]:
        index = {id(n): i for i, n in enumerate(level)}
        placed = rows.select("_size", *[c.alias(f"c{i}") for i, c in enumerate(coords)], place(root, coords, lambda n, at=index: at.get(id(n), -1)).alias("node")).where("node >= 0")
        stats = placed.groupBy("node").agg(F.sum("_size").alias("w"), *[f(f"c{i}").alias(f"{f.__name__}{i}") for i in range(n_dims) for f in (F.min, F.max)]).collect()
        ranges = {r["node"]: [(r[f"min{i}"], r[f"max{i}"]) for i in range(n_dims)] for r in stats}
        weight = {r["node"]: r["w"] for r in stats}
        spread = spread or [max(1, b - a) for a, b in ranges.get(0, [(0, 1)] * n_dims)]
        for i, n in enumerate(level):
            if i in ranges:
                n.dim = max(range(n_dims), key=lambda d: (ranges[i][d][1] - ranges[i][d][0]) / spread[d])
        for i, cut in _cuts(placed, level, ranges, weight).items():
            level[i].cut = cut
        for n in level:
            n.left, n.right = Node(n.shards // 2), Node(n.shards - n.shards // 2)
        level = [c for n in level for c in (n.left, n.right)]
    return root, heavy


def _cuts(placed: DataFrame, level: list[Node], ranges: dict, weight: dict) -> dict[int, int]:
    """For each node of the level the coordinate whose lower side has the bytes wanted, as nearly as rows allow."""
    low = {i: ranges[i][level[i].dim][0] for i in ranges}
    span = {i: ranges[i][level[i].dim][1] - low[i] + 1 for i in ranges}
    want = {i: weight[i] * (level[i].shards // 2) / level[i].shards for i in ranges}
    cut, before, open_ = {}, dict.fromkeys(ranges, 0), set(ranges)
    while open_:
        step = {i: -(-span[i] // BINS) for i in open_}
        ask = placed.sparkSession.createDataFrame([(i, level[i].dim, int(low[i]), int(span[i]), int(step[i])) for i in sorted(open_)], "node int, dim int, low long, span long, step long")
        value = F.element_at(F.array(*[F.col(c) for c in placed.columns if c[0] == "c"]), F.col("dim") + 1)
        inside = placed.join(F.broadcast(ask), "node").select("node", "_size", (value - F.col("low")).alias("o"), "span", "step").where("o >= 0 and o < span")
        got = inside.groupBy("node", F.expr("o div step").alias("bin")).agg(F.sum("_size").alias("w"), F.min("o").alias("first"), F.max("o").alias("last")).collect()  # at most BINS rows a node
        bins: dict[int, list] = {}
        for r in sorted(got, key=lambda r: (r["node"], r["bin"])):
            bins.setdefault(r["node"], []).append(r)
        for i in sorted(open_):
            for r in bins[i]:
                if before[i] + r["w"] >= want[i]:
                    break
                before[i] += r["w"]
            begin, end = low[i] + r["first"], low[i] + r["last"] + 1
            if end - begin == 1 or r["w"] <= FINE * weight[i]:
                cut[i] = begin if want[i] - before[i] < before[i] + r["w"] - want[i] else end
                open_.discard(i)
            else:
                low[i], span[i] = begin, end - begin
    return cut


def sharded(docs: DataFrame, shards: int = 40, dims: list[Column] | None = None) -> DataFrame:
    """docs with _shard (int): all rows, all columns; shards hold near equal bytes (text plus 16 a row).

    dims: numeric columns scaled to 0..1, by default those of text_dims(). Null texts are empty, null dimensions 0; a null
    id is an id like others. Rows of equal texts stay in one shard, unless they have more bytes than a whole shard is to
    hold: then only those of the same id stay together. An empty table gives no rows; with fewer groups than shards some
    shards stay empty. A column of docs named _shard gives way to the result's.
    """
    docs = without(docs, "_shard")
    given = {f"_given{i}": d for i, d in enumerate(dims or [])}
    rows = measured(set_aside(docs.withColumns(given)), [F.col("_rest")[c] for c in given] or None)
    own = [c for c in rows.columns if c[:2] == "_d" and c[2:].isdigit()]
    tree, heavy = grow(saved(rows.select("doc_id", "_size", "_h", *own)), len(own), shards)
    _numbered(tree)
    placed = rows.withColumn("_rest", F.struct(F.col("_rest").alias("row"), place(tree, coordinates(len(own), heavy), lambda n: n.cut).cast("int").alias("shard")))
    return placed.select(*[(F.col(c) if c in ("doc_id", "text") else F.col("_rest.row")[c]).alias(c) for c in docs.columns], F.col("_rest.shard").alias("_shard"))


def _numbered(tree: Node) -> None:
    """Puts each leaf's shard number into its cut, from left to right."""
    stack, at = [tree], 0
    while stack:
        n = stack.pop()
        if n.left is None:
            n.cut, at = at, at + n.shards
        else:
            stack += [n.right, n.left]


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    slot numbers the rows of a shard: its rows are dealt over SLOT_PARTS parts by a hash, parts are counted, and each
    part numbers its own rows from where the parts before it end.
    """
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    own = [c for c in rows.columns if c[:2] == "_d" and c[2:].isdigit()]
    table = saved(rows.select("doc_id", "_size", "_crc", "_h", *own))
    tree, heavy = grow(table, len(own), shards)
    _numbered(tree)
    placed = table.select("doc_id", "_size", "_crc", "_h", place(tree, coordinates(len(own), heavy), lambda n: n.cut).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "_h"), F.lit(SLOT_PARTS)).cast("int").alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # at most shards * SLOT_PARTS rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "_h")))
    out = numbered.join(F.broadcast(starts), ["shard", "part"])
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
