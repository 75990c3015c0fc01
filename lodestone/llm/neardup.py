"""Near-duplicate documents by a signature-coordinate inverted join.

1. Every text becomes the set of hashes of its distinct 5-word shingles, a 128-bit digest of that set and a MinHash
   signature of COORDS coordinates. Texts with equal sets are one class, known by its smallest document.
2. A class is posted under each (coordinate, value) of its signature. Two classes are candidates if at least MATCH of the
   COORDS coordinates agree. By the prefix rule, two such classes meet in a list of the COORDS - MATCH + 1 rarest values
   of each (rarest over the whole corpus first); all other postings are skipped. Values that no other class has are the
   rarest and have no list.
3. In a few rounds every class meets one class, the hub, of each list that still holds several components: the HUBS
   hubs that it collides with most often. Linked classes share a component from the next round on.
4. Then lists that still hold several components are compared whole, in tiles: the classes outside a list's largest
   component, by blocks, against all of the list, by blocks. A pair from different components whose signatures agree
   often enough is a candidate in one list only, that of the first coordinate that is in the prefix of both.
5. Candidates of both kinds are decided where they are found. A tile (a hub with a part of its classes is one too) first
   sees signatures only and names its classes that have any candidate, in blocks. Each block then gets these classes'
   full shingle sets once, finds its candidates again and decides them. Of the links it finds it writes those that join
   components, one fewer than the components it joins. Pairs that are candidates and no links are never written.
6. Components of all links give the result.

A second signature of COORDS short values, used for comparing only, sharpens the test: of both signatures' 128
coordinates at least MATCH_ALL must agree. For a pair right at the threshold, fewer than MATCH = 32 of 64 or fewer than
MATCH_ALL = 73 of 128 have a chance of about 4e-6 each, and much less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import textarrays as T
from lodestone.llm.common import lean, saved
from lodestone.llm.components import components
from lodestone.session import dropped

COORDS, MATCH, MATCH_ALL = 64, 32, 73
#: The least similarity for which MATCH and MATCH_ALL hold.
LEAST = 0.75
#: A tile compares ROWS classes outside a list's largest component with COLUMNS classes of the list, about.
ROWS, COLUMNS = 1024, 1024
#: Candidates are decided in blocks of SET_ROWS by SET_COLUMNS classes of a tile.
SET_ROWS, SET_COLUMNS = 64, 192
#: Hubs that a class is compared with in a round, and rounds at most; what they leave open is for the tiles.
HUBS, ROUNDS = 3, 1
#: Parts that the members of a class, or the classes of a hub, are dealt over to meet it.
SALTS = 16

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 63, 2 * COORDS, np.uint64) * np.uint64(2)
_MUL = _rng.integers(0, 1 << 63, 2 * COORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 2 * COORDS unsigned 64-bit minima for each text; texts without shingles must not be among them."""
    out = np.empty((len(offsets) - 1, 2 * COORDS), np.uint64)
    for k in range(2 * COORDS):
        v = shingles ^ _XOR[k]
        v *= _MUL[k]
        v ^= v >> np.uint64(32)
        v *= np.uint64(0x9FB21C651E98DF25)
        out[:, k] = np.minimum.reduceat(v, offsets[:-1])
    return out


def shingle_sets(chunk: T.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins."""
    all_of, at = T.shingles(T.words(chunk), size)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(all_of, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    all_of, text = all_of[order], text[order]
    new = np.ones(len(all_of), bool)
    new[1:] = (all_of[1:] != all_of[:-1]) | (text[1:] != text[:-1])
    return all_of[new], np.searchsorted(text[new], np.arange(len(at)))


def _digest(sets: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
    """64 of the 128 bits that stand for each text's whole set; 0 for an empty one."""
    some = np.diff(at) > 0
    d = np.zeros(len(some), np.uint64)
    if some.any():
        d[some] = np.add.reduceat(T.mix(sets + np.uint64((0x1234567, 0x89ABCDEF01)[half])), at[:-1][some])
    return d


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest1, digest2, coords, checks): coords and checks are empty where there is no shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for c in T.chunks(b.column("text")):
                sets, at = shingle_sets(c, size)
                n = np.diff(at)
                some = n > 0
                packed = np.concatenate((at[:-1][some], [len(sets)]))
                coords = signature(sets, packed) if some.any() else np.zeros((0, 2 * COORDS), np.uint64)
                digests = [pa.array(_digest(sets, at, half).view(np.int64)) for half in (0, 1)]
                ends = np.concatenate(([0], np.cumsum(np.where(some, COORDS, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(coords[:, :COORDS]).view(np.int64).ravel()))
                shorts = pa.ListArray.from_arrays(pa.array(ends), pa.array((coords[:, COORDS:] >> np.uint64(48)).astype(np.uint16).view(np.int16).ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, len(n)), pa.array(n.astype(np.int64)), *digests, lists, shorts], names=["doc_id", "n_shingles", "digest1", "digest2", "coords", "checks"])

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return few.mapInArrow(lean(run), "doc_id long, n_shingles long, digest1 long, digest2 long, coords array<long>, checks array<smallint>")


def prefix_postings(classes: DataFrame) -> DataFrame:
    """(id, d, k, key, mask) for the rarest values of each class, as far as other classes have them too.

    k is the value's coordinate; mask has the bits of all coordinates that the class is posted under.
    """
    posted = classes.select("id", "d", F.posexplode("coords").alias("k", "value")).select("id", "d", "k", F.xxhash64("k", "value").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = posted.join(shared, "key")
    mine = Window.partitionBy("id", "d")
    ranked = known.withColumns({"has": F.count(F.lit(1)).over(mine), "rank": F.row_number().over(mine.orderBy("n", "key"))})
    few = ranked.where(F.col("rank") <= COORDS - MATCH + 1 - (COORDS - F.col("has")))
    return few.select("id", "d", "k", "key", F.bit_or(F.expr("shiftleft(1L, k)")).over(mine).alias("mask"))


def _rooted(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return postings.withColumn("root", F.col("id"))
    return postings.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _hub_tiles(rooted: DataFrame, round_: int) -> DataFrame:
    """Tiles (key, i, j, id, d, k, root, top, mask, is_row) of a class with hubs of other components, HUBS for each class at most.

    The hub is a tile's only row; its classes are the columns, about COLUMNS in a tile.
    """
    order = F.col("id") if round_ == 0 else F.xxhash64("id", "d", "key", F.lit(round_))
    lists = rooted.groupBy("key").agg(F.min_by(F.struct("id", "d", "root"), order).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    met = rooted.join(lists, "key").where(F.col("root") != F.col("hub.root")).groupBy("id", "d", "root", "hub").agg(F.count(F.lit(1)).alias("n"))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("id", "d").orderBy(F.desc("n"), "hub"))).where(F.col("rank") <= HUBS)
    pairs = saved(ranked.select("id", "d", "root", "hub"))
    salt = F.pmod(F.xxhash64("id", "d"), F.lit(SALTS)).cast("int")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / COLUMNS).alias("parts"), F.collect_set(salt).alias("salts"))
    met = pairs.withColumn("salt", salt).join(parts.withColumn("salt", F.explode("salts")), ["hub", "salt"])
    columns = met.select(F.col("hub.id").alias("key"), F.pmod(F.xxhash64("d", "id"), F.col("parts")).alias("i"), "id", "d", "root", F.lit(False).alias("is_row"))
    rows = parts.select(F.col("hub.id").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.col("hub.id").alias("id"), F.col("hub.d").alias("d"), F.col("hub.root").alias("root"), F.lit(True).alias("is_row"))
    # Any class may be a row's partner (top), and there is no other list in which a pair could be a candidate (mask).
    return columns.unionByName(rows).withColumns({"j": F.lit(0).cast("long"), "k": F.lit(0), "top": F.lit(True), "mask": F.lit(0).cast("long")})


def _list_tiles(rooted: DataFrame) -> DataFrame:
    """Tiles (key, i, j, id, d, k, root, top, mask, is_row) of the lists that hold several components."""
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")).where("most.n < n")
    grid = sizes.select("key", F.col("most.root").alias("largest"), F.ceil((F.col("n") - F.col("most.n")) / ROWS).alias("rows"), F.ceil(F.col("n") / COLUMNS).alias("cols"))
    members = rooted.join(grid, "key")
    place = lambda n: F.pmod(F.xxhash64("id", "d", F.lit(n)), F.col(n))
    zero = F.lit(0).cast("long")
    as_col = F.transform(F.sequence(zero, F.col("rows") - 1), lambda i: F.struct(i.alias("i"), place("cols").alias("j"), F.lit(False).alias("is_row")))
    as_row = F.transform(F.sequence(zero, F.col("cols") - 1), lambda j: F.struct(place("rows").alias("i"), j.alias("j"), F.lit(True).alias("is_row")))
    top = F.col("root") == F.col("largest")
    tiles = members.withColumns({"top": top, "tile": F.explode(F.when(top, as_col).otherwise(F.concat(as_col, as_row)))})
    return tiles.select("key", "tile.i", "tile.j", "id", "d", "k", "root", "top", "mask", "tile.is_row")


PLACE = ("key", "i", "j")
MEMBER = ("id", "d", "k", "root", "top", "mask", "is_row")
_MEMBER_TYPES = "key long, i long, j long, id long, d long, k int, root long, top boolean, mask long, is_row boolean"


def _tile_links(tiles: DataFrame, classes: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame | None:
    """Links (a, b) that join the components of each block of a tile, or None; full sets decide."""
    sketch = ("n_shingles", "coords", "checks")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _runs(batches, PLACE):
            yield from _with_candidates(tile, threshold)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, PLACE):
            links = _block_links(block, threshold)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*links, strict=True)], names=["a", "b"])

    dealt = tiles.join(classes, ["id", "d"]).select(*PLACE, *MEMBER, *sketch).repartition(*PLACE).sortWithinPartitions(*PLACE)
    members = saved(dealt.mapInArrow(lean(name), _MEMBER_TYPES))
    if members.isEmpty():
        dropped(members)
        return None
    whole = classes.join(_set_table(docs, members.select("id").distinct(), size), ["id", "d"])
    blocks = members.join(whole, ["id", "d"]).select(*PLACE, *MEMBER, *sketch, "shingles").repartition(*PLACE).sortWithinPartitions(*PLACE)
    found = saved(blocks.mapInArrow(lean(decide), "a long, b long").distinct())
    dropped(members)
    return found


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by key. Only the rows of a key that goes on in the next batch are copied."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist(), b.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            run = pa.Table.from_batches([b.slice(begin, end - begin)])
            if rest is not None:
                if all(rest[k][0] == run[k][0] for k in keys):
                    rest = pa.concat_tables([rest, run]).combine_chunks()
                    continue
                yield rest
            rest = run
        if rest is not None:
            rest = rest.take(pa.array(np.arange(rest.num_rows)))  # lets go of the batch
    if rest is not None:
        yield rest

def _candidates(tile: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the tile that has candidates its place in the table, and the places of these columns."""
    ids, root, n, mask = (tile[c].to_numpy() for c in ("id", "root", "n_shingles", "mask"))
    is_row, top = (tile[c].to_numpy(zero_copy_only=False) for c in ("is_row", "top"))
    k = tile["k"][0].as_py()
    coords, checks = (tile[c].combine_chunks().flatten().to_numpy().reshape(-1, COORDS) for c in ("coords", "checks"))
    in_prefix = (mask[:, None] >> np.arange(COORDS)) & 1 == 1
    cols = np.flatnonzero(~is_row)
    for x in np.flatnonzero(is_row).tolist():
        # Of two classes outside the largest component, the smaller id is the row.
        other = cols[(root[cols] != root[x]) & (top[cols] | (ids[cols] > ids[x])) & (np.minimum(n[cols], n[x]) >= threshold * np.maximum(n[cols], n[x]))]
        if not len(other):
            continue
        same = coords[other] == coords[x]
        agree = same.sum(axis=1)
        near = np.flatnonzero(agree >= MATCH)
        near = near[~(same[near, :k] & in_prefix[other[near], :k] & in_prefix[x, :k]).any(axis=1)]
        other, agree = other[near], agree[near]
        other = other[agree + (checks[other] == checks[x]).sum(axis=1) >= MATCH_ALL]
        if len(other):
            yield x, other


def _with_candidates(tile: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """The members of a tile's blocks, SET_ROWS rows by SET_COLUMNS columns of those that have candidates in the tile."""
    rows, columns = [], np.zeros(tile.num_rows, bool)
    for x, other in _candidates(tile, threshold):
        rows.append(x)
        columns[other] = True
    columns = np.flatnonzero(columns)
    i, j = (tile[c][0].as_py() << 20 for c in ("i", "j"))
    few = tile.select([*PLACE, *MEMBER])
    for r in range(0, len(rows), SET_ROWS):
        for c in range(0, len(columns), SET_COLUMNS):
            block = few.take(np.concatenate((np.array(rows[r : r + SET_ROWS], np.int64), columns[c : c + SET_COLUMNS])))
            place = {"i": i + r // SET_ROWS, "j": j + c // SET_COLUMNS}
            named = [pa.array(np.full(block.num_rows, place[k], np.int64)) if k in place else block[k].combine_chunks() for k in few.column_names]
            yield pa.RecordBatch.from_arrays(named, names=few.column_names)


def _set_table(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, d, shingles): the sorted full shingle set of each text of a wanted id, and the first half of its digest."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in T.chunks(b.column("text")):
                sets, at = shingle_sets(c, size)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(c.first, len(at) - 1), pa.array(_digest(sets, at, 0).view(np.int64)), lists], names=["id", "d", "shingles"])

    return texts.mapInArrow(lean(run), "id long, d long, shingles array<long>").dropDuplicates(["id", "d"])


def _block_links(block: pa.Table, threshold: float) -> list[tuple[int, int]]:
    """Links (smaller id, larger id) between components of the block: candidates whose full sets are alike enough."""
    num = round(threshold * 100)
    ids, root = block["id"].to_pylist(), block["root"].to_pylist()
    lists = block["shingles"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    n = np.diff(ends)
    joined: dict[int, int] = {}

    def end(x: int) -> int:
        while (up := joined.get(x, x)) != x:
            x = up
        return x

    links = []
    for x, other in _candidates(block, threshold):
        own = flat[ends[x] : ends[x + 1]]
        apart = [y for y in other.tolist() if end(root[y]) != end(root[x])]
        for at in range(0, len(apart), 32):  # what is linked meanwhile needs no comparison
            some = [y for y in apart[at : at + 32] if end(root[y]) != end(root[x])]
            if not some:
                continue
            data, size = np.concatenate([flat[ends[y] : ends[y + 1]] for y in some]), n[some]
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            place = np.minimum(np.searchsorted(own, data), len(own) - 1)
            common = np.add.reduceat((own[place] == data).astype(np.int64), starts)
            for t in np.flatnonzero(100 * common >= num * (size + len(own) - common)).tolist():
                y = some[t]
                low, high = sorted((end(root[x]), end(root[y])))
                if low != high:
                    joined[high] = low
                    links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
    return links


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text, ...).

    component_id is the smallest id that the document is linked with over any number of links, itself included. Texts
    without words have no shingles and no links. A row with a null id has no links and a null component_id. Rows with
    the same id are one document: it is linked if any of their texts is. threshold is LEAST or more.
    """
    if threshold < LEAST:
        raise ValueError(f"links under {LEAST} would be missed")
    found = saved(sketches(docs, size))
    real = found.where("n_shingles > 0 and doc_id is not null")
    # Of each class the smallest id; a class with many copies is dealt over SALTS parts to meet it.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    firsts = real.groupBy("digest1", "digest2").agg(F.min("doc_id").alias("id"), F.collect_set(salt).alias("salts"))
    met = real.select("doc_id", "digest1", "digest2", salt.alias("salt")).join(firsts.withColumn("salt", F.explode("salts")), ["digest1", "digest2", "salt"])
    member = saved(met.select("doc_id", "id").distinct())
    rows = real.join(firsts.select("digest1", "digest2", "id", F.col("id").alias("doc_id")), ["digest1", "digest2", "doc_id"])
    classes = saved(rows.dropDuplicates(["id", "digest1", "digest2"]).select("id", F.col("digest1").alias("d"), "n_shingles", "coords", "checks"))

    postings = saved(prefix_postings(classes))
    links, roots = None, None
    for round_ in range(ROUNDS + 1):
        rooted = _rooted(postings, roots)
        new = _tile_links(_hub_tiles(rooted, round_) if round_ < ROUNDS else _list_tiles(rooted), classes, docs, size, threshold)
        if new is not None:
            links = new if links is None else links.unionByName(new)
            roots = components(links) if round_ < ROUNDS else None
    class_links = member.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0) if links is None else links
    # Only ids with several texts tie two classes together; all else joins its class at the end.
    several = member.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    ties = member.join(several, "doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    roots = components(class_links.unionByName(ties))
    component = member.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("component")).groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = found.select("doc_id", "n_shingles").join(component, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_dup_report(docs: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    return near_duplicates(docs, size, threshold).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """The rows of docs, all columns as they were, without those whose component has a smaller id.

    Rows with a null id stay. Of rows that share an id all stay, or none.
    """
    gone = near_duplicates(docs, size, threshold).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
