"""Property-graph queries over nodes (id, type, name, dates, place, confidence, ...) and edges (id, src, predicate, dst, confidence).

Paths of bounded length are a chain of joins, each from the frontier to the edges. Searches without a bound, and those that
remember what they have seen, run level by level: a level is one join and one anti join, written to the shared folder
before the next begins. Which side of a join is broadcast is left to adaptive execution, by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.propagation import propagated
from lodestone.session import dropped, materialised

R_EARTH = 6371.0


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other, id, predicate, confidence), each edge from both ends."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return edges.select(ends.alias("e"), "id", "predicate", "confidence").select("e.node", "e.other", "id", "predicate", "confidence")


def of_types(edges: DataFrame, predicates: list[str] | None) -> DataFrame:
    return edges.where(F.col("predicate").isin(predicates)) if predicates else edges


def _chains(edges: DataFrame, start: str, come: str, go: str, max_depth: int, min_confidence: float) -> DataFrame:
    """(node, path, confidence, depth) of all simple chains from start; an edge leads from its column come to its column go.

    Each level is written before the next begins, so that a level is worked out once.
    """
    steps = materialised(edges.where(F.col("confidence") >= min_confidence).select(F.col(come).alias("_at"), F.col(go).alias("_to"), F.col("confidence").alias("_c")))
    level = edges.sparkSession.createDataFrame([(start, [start], 1.0, 0)], "node string, path array<string>, confidence double, depth int")
    found = [level.limit(0)]
    for _ in range(max_depth):
        level = level.join(steps, F.col("node") == F.col("_at")).where(~F.array_contains("path", F.col("_to")))
        level = materialised(level.select(F.col("_to").alias("node"), F.array_append("path", F.col("_to")).alias("path"), (F.col("confidence") * F.col("_c")).alias("confidence"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def _best_chain(edges: DataFrame, start: str, come: str, go: str, max_depth: int, min_confidence: float) -> DataFrame:
    """(root, depth, confidence, path): the most probable simple chain from start to a node that leads no further, then the
    shortest, then the first by path; no row where there is none. An edge leads from its column come to its column go.

    Every second level only the best chain to each node is kept: what is best to a node begins with what is best to the one before.
    That fails only where a chain could not go on because it has the node already; then all chains are compared.
    """
    spark = edges.sparkSession
    steps = edges.where(F.col("confidence") >= min_confidence).select(F.col(come).alias("_at"), F.col(go).alias("_to"), F.col("confidence").alias("_c"))
    leads = edges.select(F.col(come).alias("_at")).distinct()
    steps = materialised(steps.join(leads.select(F.col("_at").alias("_to"), F.lit(True).alias("_on")), "_to", "left").select("_at", "_to", "_c", F.col("_on").isNull().alias("_end")))
    state = "node string, path array<string>, confidence double, depth int, ended boolean, barred boolean"
    level = spark.createDataFrame([(start, [start], 1.0, 0, False, False)], state)
    order = F.struct((-F.col("confidence")).alias("c"), F.col("depth"), F.concat(F.concat_ws(">", "path"), F.lit(">")).alias("p"))
    for depth in range(1, max_depth + 1):
        # Ended and barred rows are carried along as they are (one reference to the level, or plans would double); the best ended one is enough.
        done = F.col("ended") | F.col("barred")
        met = level.join(steps, (F.col("node") == F.col("_at")) & ~done, "left").where(done | F.col("_to").isNotNull())
        bar = F.array_contains("path", F.col("_to"))
        new = met.select(
            F.when(done, F.col("node")).when(~bar, F.col("_to")).alias("node"), F.when(done, F.col("path")).when(~bar, F.array_append("path", F.col("_to"))).alias("path"),
            F.when(done, F.col("confidence")).otherwise(F.col("confidence") * F.col("_c")).alias("confidence"), (F.col("depth") + F.when(done, 0).otherwise(1)).alias("depth"),
            F.when(done, F.col("ended")).otherwise(F.col("_end") & ~bar).alias("ended"), F.when(done, F.col("barred")).otherwise(bar).alias("barred"),
        )
        if depth % 2 and depth < max_depth:  # a shuffle for every two steps
            level = new
            continue
        key = F.when(F.col("ended"), F.lit("")).otherwise(F.col("node"))
        level = new.groupBy("ended", "barred", key.alias("_k")).agg(F.min_by(F.struct("node", "path", "confidence", "depth"), order).alias("b")).select("b.*", "ended", "barred")
    found = level.where("ended or barred").collect()  # two rows at most
    if any(r["barred"] for r in found):
        every = _chains(edges, start, come, go, max_depth, min_confidence)
        best = every.join(leads.withColumnRenamed("_at", "node"), "node", "left_anti").orderBy(F.desc("confidence"), "depth", F.concat_ws(">", "path")).limit(1)
        return best.select(F.col("node").alias("root"), "depth", "confidence", "path")
    return spark.createDataFrame([(r["node"], r["depth"], r["confidence"], r["path"]) for r in found], "root string, depth int, confidence double, path array<string>")


def teacher_lineage(edges: DataFrame, person: str, max_depth: int = 10, min_confidence: float = 0.0) -> DataFrame:
    """(root, depth, confidence, chain): the best chain of teachers up to one who has no teacher; no row without a teacher."""
    best = _best_chain(of_types(edges, ["teacher_of"]), person, "dst", "src", max_depth, min_confidence)
    return best.select("root", "depth", F.round("confidence", 6).alias("confidence"), F.concat_ws(">", F.reverse("path")).alias("chain"))


def student_lineage(edges: DataFrame, person: str, max_depth: int = 10, min_confidence: float = 0.0) -> DataFrame:
    """(root, depth, confidence, chain): the best chain along student_of edges, against their direction, to one that no edge leads on from."""
    best = _best_chain(of_types(edges, ["student_of"]), person, "dst", "src", max_depth, min_confidence)
    return best.select("root", "depth", F.round("confidence", 6).alias("confidence"), F.concat_ws(">", "path").alias("chain"))


def reachable(edges: DataFrame, start: str, come: str, go: str, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of all nodes that can be reached, start not among them unless a cycle leads back; depth is the least."""
    steps = edges.select(F.col(come).alias("node"), F.col(go).alias("to")).distinct()
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start,)], "node string")
    seen, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(steps, "node").select(F.col("to").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, "node", "left_anti")
        new = materialised(new.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.select("node")
    return seen if seen is not None else spark.createDataFrame([], "node string, depth int")


def incarnation_line(nodes: DataFrame, edges: DataFrame, person: str) -> DataFrame:
    """(position, id, name, birth): all predecessors, the person and all successors by birth year, unknown years last."""
    own = of_types(edges, ["incarnation_of"])
    line = reachable(own, person, "src", "dst").select("node").unionByName(reachable(own, person, "dst", "src").select("node"))
    line = line.unionByName(edges.sparkSession.createDataFrame([(person,)], "node string")).distinct()
    found = nodes.join(line, F.col("id") == F.col("node"))
    place = F.row_number().over(Window.orderBy(F.coalesce("birth", F.lit(9999)), "id"))  # one line of incarnations
    return found.select(place.cast("long").alias("position"), "id", "name", "birth")


def _neighbours(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, c) of the edges steps (a, b, c) at either end of nodes (node); a few nodes go to the edges, not the edges to them."""
    side = lambda at, to: steps.join(nodes.withColumnRenamed("node", at), at).select(F.col(at).alias("node"), F.col(to).alias("other"), "c")
    return side("a", "b").unionByName(side("b", "a"))


def _met(steps: DataFrame, start: str, target: str, max_length: int) -> list[DataFrame] | None:
    """The nodes (node) at each distance from start on any shortest path to target, or None.

    Levels are searched from both ends, from the smaller one next, until they meet.
    """
    spark = steps.sparkSession
    sides = [[spark.createDataFrame([(end,)], "node string")] for end in (start, target)]
    sizes, seen = [1, 1], [side[0] for side in sides]
    if start == target:
        return None
    meeting = None
    while len(sides[0]) + len(sides[1]) - 2 < max_length:
        k = 0 if sizes[0] <= sizes[1] else 1
        new = _neighbours(steps, sides[k][-1]).select(F.col("other").alias("node")).distinct().join(seen[k], "node", "left_anti")
        new = materialised(new)
        sizes[k] = new.count()
        if not sizes[k]:
            return None
        sides[k].append(new)
        seen[k] = seen[k].unionByName(new)
        both = new.join(sides[1 - k][-1], "node", "left_semi")
        if not both.isEmpty():
            meeting = materialised(both)
            break
    if meeting is None:
        return None
    out = [[meeting], [meeting]]
    for k in (0, 1):  # back to either end, only over nodes that lead to the meeting
        for level in reversed(sides[k][:-1]):
            back = _neighbours(steps, out[k][-1]).select(F.col("other").alias("node")).distinct().join(level, "node", "left_semi")
            out[k].append(materialised(back))
    return [*reversed(out[0]), *out[1][1:]]


def _steps(edges: DataFrame, predicates: list[str] | None) -> DataFrame:
    return materialised(of_types(edges, predicates).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("confidence").alias("c")))


def shortest_path(edges: DataFrame, start: str, target: str, max_length: int = 10, predicates: list[str] | None = None) -> DataFrame:
    """(path, length, confidence) of one shortest path: the most probable, then the first by name. No row where there is none."""
    return shortest_paths(edges, start, target, max_length, 1, predicates)


def shortest_length(edges: DataFrame, start: str, target: str, max_length: int = 10, predicates: list[str] | None = None) -> DataFrame:
    """(start, target, length); no row where there is no path of at most max_length edges; 0 for a node and itself."""
    found = None if start == target else _met(_steps(edges, predicates), start, target, max_length)
    rows = [(start, target, 0)] if start == target else [(start, target, len(found) - 1)] if found else []
    return edges.sparkSession.createDataFrame(rows, "start string, target string, length long")


#: Costs of paths are whole numbers, so that a path's cost does not depend on the order of its edges.
COST = 1_000_000_000


def shortest_paths(edges: DataFrame, start: str, target: str, max_length: int = 5, limit: int = 10, predicates: list[str] | None = None) -> DataFrame:
    """(path, length, confidence) of the limit most probable shortest paths, then the first by name. Of parallel edges the most
    probable counts. Probability goes by the sum of -ln(confidence) of the edges, each to nine digits.

    At each node only the limit best ways that lead there are kept, so that rows are bounded by nodes times limit, not by the
    number of paths.
    """
    spark = edges.sparkSession
    steps = _steps(edges, predicates)
    levels = _met(steps, start, target, max_length)
    if levels is None:
        return spark.createDataFrame([], "path string, length long, confidence double")
    paths = spark.createDataFrame([(start, start, 0, 1.0)], "node string, path string, cost long, confidence double")
    # The order of whole paths is that of their beginnings if these end in the sign that parts nodes.
    first = Window.partitionBy("node").orderBy("cost", F.concat("path", F.lit(">")))
    for near, far in zip(levels[:-1], levels[1:]):
        on = _neighbours(steps, near).join(far.withColumnRenamed("node", "other"), "other", "left_semi").groupBy("node", "other").agg(F.max("c").alias("c"))
        cost = F.round(-F.log(F.greatest("c", F.lit(1e-300))) * COST).cast("long")
        ways = paths.join(on, "node").select(F.col("other").alias("node"), F.concat_ws(">", "path", "other").alias("path"), (F.col("cost") + cost).alias("cost"), (F.col("confidence") * F.col("c")).alias("confidence"))
        paths = ways.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit).drop("_r")
    best = paths.orderBy("cost", "path").limit(limit)
    return best.select("path", F.lit(len(levels) - 1).cast("long").alias("length"), F.round("confidence", 6).alias("confidence"))


def network_paths(nodes: DataFrame, edges: DataFrame, centre: str, depth: int = 2, min_confidence: float = 0.0, predicates: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """(at, type, name, first, confidence, hops): a row for each node within depth undirected hops over edges of min_confidence
    or more and each first edge (its id and confidence) of a path that leads there; hops is the least. The centre is left out."""
    steps = materialised(undirected(of_types(edges, predicates).where(F.col("confidence") >= min_confidence)).select("node", F.col("other").alias("to"), "id", "confidence"))
    level = steps.where(F.col("node") == centre).select(F.col("to").alias("at"), F.col("id").alias("first"), "confidence", F.lit(1).alias("hops"))
    found = [level]
    for hop in range(2, depth + 1):
        level = level.join(steps.select("node", "to"), F.col("at") == F.col("node")).select(F.col("to").alias("at"), "first", "confidence").distinct().withColumn("hops", F.lit(hop))
        level = materialised(level)
        found.append(level)
    every = reduce(DataFrame.unionByName, found).where(F.col("at") != centre).groupBy("at", "first").agg(F.max("confidence").alias("confidence"), F.min("hops").alias("hops"))
    out = every.join(nodes.select(F.col("id").alias("at"), "type", "name"), "at")
    return (out.where(F.col("type").isin(types)) if types else out).select("at", "type", "name", "first", "confidence", "hops")


def network(nodes: DataFrame, edges: DataFrame, centre: str, depth: int = 2, min_confidence: float = 0.0, predicates: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """(id, type, name, hops, confidence): nodes within depth hops; confidence is the highest of the first edges that lead there."""
    by = network_paths(nodes, edges, centre, depth, min_confidence, predicates, types).groupBy(F.col("at").alias("id"), "type", "name")
    return by.agg(F.min("hops").cast("long").alias("hops"), F.round(F.max("confidence"), 6).alias("confidence"))


def network_edges(paths: DataFrame) -> DataFrame:
    """(id, confidence): the distinct first edges of network_paths()."""
    return paths.groupBy(F.col("first").alias("id")).agg(F.round(F.max("confidence"), 6).alias("confidence"))


def network_summary(paths: DataFrame) -> DataFrame:
    """One row (nodes, edges, confidence) of network_paths(): numbers of both, and the mean over node and first edge."""
    return paths.agg(F.count_distinct("at").alias("nodes"), F.count_distinct("first").alias("edges"), F.round(F.avg("confidence"), 6).alias("confidence"))


def contemporaries(nodes: DataFrame, edges: DataFrame, person: str, years: int = 50, same_place: bool = False, same_tradition: bool = False, limit: int = 50) -> DataFrame:
    """(id, name, birth, apart): persons born from the person's birth less years to their death (or birth + 80) plus years."""
    me = nodes.where(F.col("id") == person).select(F.col("id").alias("me"), F.col("birth").alias("b"), F.coalesce("death", F.col("birth") + 80).alias("d"), F.col("tradition").alias("own"))  # one row
    out = nodes.where((F.col("type") == "person") & (F.col("id") != person)).join(F.broadcast(me), F.col("birth").between(F.col("b") - years, F.col("d") + years))
    if same_tradition:
        out = out.where(F.col("tradition") == F.col("own"))
    if same_place:
        at = of_types(edges, ["lived_at", "studied_at", "taught_at"]).select("src", "dst")
        shared = at.join(at.where(F.col("src") == person).select("dst").distinct(), "dst", "left_semi").select(F.col("src").alias("id"))
        out = out.join(shared, "id", "left_semi")
    return out.select("id", "name", "birth", F.abs(F.col("birth") - F.col("b")).alias("apart")).orderBy("apart", "id").limit(limit)


def timeline(nodes: DataFrame, edges: DataFrame, start: int, end: int, types: tuple[str, ...] = ("person", "event", "text", "institution"), place: str | None = None, tradition: str | None = None, limit: int = 1000) -> DataFrame:
    """(id, type, name, year, label): nodes with any date in the range; the year is birth, founding or event (not death)."""
    dates = ("birth", "death", "founded", "occurred")
    inside = reduce(Column.__or__, (F.col(c).between(start, end) for c in dates))
    out = nodes.where(F.col("type").isin(list(types)) & inside)
    if tradition:
        out = out.where(F.col("tradition") == tradition)
    if place:
        there = of_types(edges, ["located_at", "lived_at", "founded_at"]).join(nodes.where((F.col("type") == "place") & (F.col("name") == place)).select(F.col("id").alias("dst")), "dst", "left_semi")
        out = out.join(there.select(F.col("src").alias("id")), "id", "left_semi")
    label = F.when(F.col("birth").isNotNull(), "birth").when(F.col("founded").isNotNull(), "founded").when(F.col("occurred").isNotNull(), "occurred").otherwise("written")
    out = out.select("id", "type", "name", F.coalesce("birth", "founded", "occurred").alias("year"), label.alias("label"))
    return out.orderBy(F.asc_nulls_last("year"), "id").limit(limit)


def entity_timeline(nodes: DataFrame, edges: DataFrame, entity: str) -> DataFrame:
    """(year, event, related): the entity's own dates and the dates of its neighbours with the predicate that links them."""
    me = nodes.where(F.col("id") == entity)
    own = me.select(F.explode(F.array(*[F.struct(F.col(c).alias("year"), F.lit(c).alias("event")) for c in ("birth", "death", "founded", "occurred", "written")])).alias("x")).select("x.*", F.lit(None).cast("string").alias("related"))
    near = undirected(edges).where(F.col("node") == entity).select("other", "predicate").distinct()
    dated = nodes.join(near, F.col("id") == F.col("other")).select(F.coalesce("birth", "founded", "occurred", "written").alias("year"), F.col("predicate").alias("event"), F.col("id").alias("related"))
    return own.unionByName(dated).where(F.col("year").isNotNull()).orderBy("year", "event", "related")


def texts_by_author(nodes: DataFrame, edges: DataFrame, author: str, commentaries: bool = True, by_year: bool = False) -> DataFrame:
    """(id, name, written, confidence, original): active texts the author wrote, with the text they comment on, if any."""
    comments = of_types(edges, ["commentary_on", "cites"]).groupBy("src").agg(F.min("dst").alias("original"))
    wrote = of_types(edges, ["wrote"]).where(F.col("src") == author).select("dst", F.col("confidence").alias("c"))
    out = nodes.where("merge_status = 'active'").join(wrote, F.col("id") == F.col("dst"))
    if not commentaries:
        out = out.join(of_types(edges, ["commentary_on"]).select(F.col("src").alias("id")), "id", "left_anti")
    out = out.join(comments, F.col("id") == F.col("src"), "left").select("id", "name", "written", F.round("c", 6).alias("confidence"), "original")
    return out.orderBy(*((F.coalesce("written", F.lit(9999)), "name", "id") if by_year else ("name", "id")))


def citation_network(nodes: DataFrame, edges: DataFrame, text: str, direction: str = "both", max_depth: int = 3) -> DataFrame:
    """(id, name, hops): texts within max_depth citations or commentaries, out of the text, into it, or either way."""
    own = of_types(edges, ["cites", "commentary_on"])
    if direction == "both":
        both = undirected(own).select(F.col("node").alias("src"), F.col("other").alias("dst"))
        hops = reachable(both, text, "src", "dst", max_depth)
    else:
        hops = reachable(own, text, *(("src", "dst") if direction == "outgoing" else ("dst", "src")), max_depth)
    return nodes.join(hops.where(F.col("node") != text), F.col("id") == F.col("node")).select("id", "name", F.col("depth").cast("long").alias("hops"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), 2)
    return 2 * R_EARTH * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def nearby(nodes: DataFrame, lat: float, lon: float, radius_km: float, types: tuple[str, ...] = ("place", "person", "institution"), limit: int = 100) -> DataFrame:
    """(id, type, name, km) within the radius, nearest first. A band of latitudes is cut out before distances are computed."""
    band = radius_km / 111.0 + 0.1
    near = nodes.where(F.col("type").isin(list(types)) & F.col("lat").between(lat - band, lat + band) & F.col("lon").isNotNull())
    km = haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    return near.select("id", "type", "name", F.round(km, 3).alias("km")).where(F.col("km") <= radius_km).orderBy("km", "id").limit(limit)


def person_journey(nodes: DataFrame, edges: DataFrame, person: str) -> DataFrame:
    """(place, name, purpose, confidence, lat, lon): places the person lived, studied or taught at or visited."""
    went = of_types(edges, ["lived_at", "studied_at", "taught_at", "visited"]).where(F.col("src") == person).select("dst", F.col("predicate").alias("purpose"), F.col("confidence").alias("c"))
    return nodes.join(went, F.col("id") == F.col("dst")).select(F.col("id").alias("place"), "name", "purpose", F.round("c", 6).alias("confidence"), "lat", "lon").orderBy("place", "purpose")


def journeys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(person, stop, place, name, year, end_year, purpose, confidence): the places each person lived, studied or taught at or visited, by year.

    edges may have start_year, year, end_year and purpose: year is the first of start_year and year that is known, purpose the
    predicate where none is told, an unknown confidence .5. Stops without a year come last; ties by place, purpose, end year and confidence.
    """
    told = lambda *c: F.coalesce(*[F.col(x) for x in c if x in edges.columns], F.lit(None).cast("long"))
    purpose = F.coalesce(F.col("purpose"), F.col("predicate")) if "purpose" in edges.columns else F.col("predicate")
    went = of_types(edges, ["lived_at", "studied_at", "taught_at", "visited"]).select(F.col("src").alias("person"), "dst", told("start_year", "year").alias("year"), told("end_year").alias("end_year"), purpose.alias("purpose"), F.coalesce("confidence", F.lit(0.5)).alias("c"))
    people, places = nodes.where("type = 'person'").select(F.col("id").alias("person")), nodes.where("type = 'place'").select(F.col("id").alias("dst"), "name")
    stop = F.row_number().over(Window.partitionBy("person").orderBy(F.coalesce("year", F.lit(9999)), "dst", "purpose", F.coalesce("end_year", F.lit(9999)), "c"))
    return went.join(people, "person", "left_semi").join(places, "dst").select("person", stop.alias("stop"), F.col("dst").alias("place"), "name", "year", "end_year", "purpose", F.round("c", 6).alias("confidence"))


def most_influential(nodes: DataFrame, edges: DataFrame, type_: str | None = None, tradition: str | None = None, years: tuple[int, int] | None = None, limit: int = 50) -> DataFrame:
    """(id, type, name, degree, influence): degree times mean confidence of the edges at a node, highest first.

    Written at once, as a few rows, so that the shuffles of all edges and nodes have partitions of a bounded size.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("at"), "confidence")
    score = ends.groupBy("at").agg(F.count(F.lit(1)).alias("degree"), F.avg("confidence").alias("mean"))
    own = nodes
    if type_:
        own = own.where(F.col("type") == type_)
    if tradition:
        own = own.where(F.col("tradition") == tradition)
    if years:
        own = own.where(F.coalesce("birth", "founded").between(*years))
    out = own.select("id", "type", "name").join(score, F.col("id") == F.col("at"))
    highest = lambda df: df.orderBy(F.desc("influence"), "id").limit(limit)
    return highest(materialised(highest(out.select("id", "type", "name", "degree", F.round(F.col("degree") * F.col("mean"), 4).alias("influence"))), finely=True))


def components(nodes: DataFrame, edges: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """(id, component): the smallest id that can be reached; nodes without edges are their own component.

    Large stars and small stars by turns: in each round a node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows; the rounds grow with the logarithm of the longest path.
    """
    pairs = of_types(edges, predicates).where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    pairs = materialised(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("least", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialised(small)
        if new.exceptAll(pairs).isEmpty() and pairs.exceptAll(new).isEmpty():
            break
        pairs = new
    root = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select("id").join(root, F.col("id") == F.col("u"), "left").select("id", F.coalesce("component", "id").alias("component"))


def label_propagation(nodes: DataFrame, edges: DataFrame, predicates: list[str] | None = None, rounds: int = 5, label: str = "id") -> DataFrame:
    """(id, community): each round a node takes the commonest label among its neighbours and itself, the smallest of ties.

    label names the column of nodes that is a node's first label, a different one for each. Ids that are no whole numbers are
    numbered first, which shuffles the edges twice more.
    """
    own = of_types(edges, predicates).select("src", "dst")
    named = nodes.select("id", F.col(label).alias("name"))
    if dict(nodes.dtypes)["id"] in ("bigint", "int"):
        return propagated(named.withColumn("id", F.col("id").cast("long")), own.select(*[F.col(c).cast("long").alias(c) for c in own.columns]), rounds)
    ends = own.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(nodes.select("id"))
    codes = materialised(ends.where("id is not null").distinct().select("id", F.monotonically_increasing_id().alias("code")))
    end = lambda c: codes.select(F.col("id").alias(c), F.col("code").alias(f"_{c}"))
    pairs = own.join(end("src"), "src").join(end("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    found = propagated(named.join(codes, "id").select(F.col("code").alias("id"), "name"), pairs, rounds)
    return found.join(codes.withColumnRenamed("id", "_id"), F.col("id") == F.col("code")).select(F.col("_id").alias("id"), "community")


def suggest_links(edges: DataFrame, node: str, min_similarity: float = 0.5, limit: int = 10, distinct_neighbours: bool = False) -> DataFrame:
    """(id, common, similarity): nodes two hops away and not adjacent, by shared paths over the union of both degrees."""
    steps = undirected(edges).select("node", "other")
    if distinct_neighbours:
        steps = steps.distinct()
    mine = steps.where(F.col("node") == node).select(F.col("other").alias("via"))
    pairs = mine.join(steps, F.col("via") == F.col("node")).where(F.col("other") != node).groupBy(F.col("other").alias("id")).agg(F.count(F.lit(1)).alias("common"))
    far = pairs.where("common >= 2").join(mine.select(F.col("via").alias("id")), "id", "left_anti")
    degree = steps.join(far.select(F.col("id").alias("node")), "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("theirs"))
    own = mine.agg(F.count(F.lit(1)).alias("own"))
    out = far.join(degree, F.col("id") == F.col("node")).join(F.broadcast(own)).withColumn("similarity", F.round(F.col("common") / (F.col("own") + F.col("theirs") - F.col("common")), 6))
    return out.select("id", "common", "similarity").orderBy(F.desc("similarity"), "id").limit(limit).where(F.col("similarity") >= min_similarity)


def search(nodes: DataFrame, query: str, types: list[str] | None = None, fuzzy: bool = True, limit: int = 20) -> DataFrame:
    """(id, type, name, score): active nodes whose name holds the query, whatever the case; exact names first."""
    name, q = F.lower("name"), query.lower()
    out = nodes.where("merge_status = 'active'").where(name.contains(q) if fuzzy else F.col("name") == query)
    if types:
        out = out.where(F.col("type").isin(types))
    score = F.when(F.col("name") == query, 1.0).when(name == q, 0.9).when(name.startswith(q), 0.8).when(name.contains(q), 0.7).otherwise(0.5)
    return out.select("id", "type", "name", score.alias("score")).orderBy(F.desc("score"), "name", "id").limit(limit)


def search_names(nodes: DataFrame, query: str, types: list[str] | None = None, fuzzy: bool = True, limit: int = 20) -> DataFrame:
    """(id, type, name, score, field): active nodes (with english, tibetan and phonetic: arrays of names) of which some name holds the
    query, whatever the case; without fuzzy, of which one is the query.

    1.0 if the name is the query, .8 if it holds it, .9 or .7 if an english name does, else .5; field is the first kind of name that
    fits. Highest first, then by name and id. Null names and arrays hold nothing.
    """
    q = query.lower()
    name, low = F.lower(F.coalesce("name", F.lit(""))), lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.coalesce(x, F.lit(""))))
    holds = lambda c: F.exists(low(F.col(c)), lambda x: F.contains(x, F.lit(q)))
    kinds = ("english", "tibetan", "phonetic")
    fits = (name.contains(q) if fuzzy else F.col("name") == query) | F.lit(False)
    for c in kinds:
        fits = fits | F.coalesce(holds(c) if fuzzy else F.array_contains(c, query), F.lit(False))
    out = nodes.where("merge_status = 'active'").where(fits)
    if types:
        out = out.where(F.col("type").isin(types))
    score = F.when(name == q, 1.0).when(name.contains(q), 0.8).when(F.array_contains(low(F.col("english")), q), 0.9).when(holds("english"), 0.7).otherwise(0.5)
    field = F.when(name == q, "name").when(holds("english"), "english").when(holds("tibetan"), "tibetan").otherwise("other")
    return out.select("id", "type", "name", score.alias("score"), field.alias("field")).orderBy(F.desc("score"), "name", "id").limit(limit)


def label_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n) of node types and predicates."""
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("predicate").alias("label")).agg(F.count(F.lit(1)).alias("n")))


def merge_rewire(edges: DataFrame, primary: str, duplicate: str) -> DataFrame:
    """(src, predicate, dst, confidence): edges after duplicate went into primary: its edges move unless primary has one with that node."""
    ends = edges.where(F.col("src").eqNullSafe(F.lit(duplicate)) | F.col("dst").eqNullSafe(F.lit(duplicate)))
    rest = edges.where((F.col("src") != duplicate) & (F.col("dst") != duplicate))
    linked = undirected(edges).where(F.col("node") == primary).select("other").distinct()
    moved = ends.withColumn("other", F.when(F.col("src") == duplicate, F.col("dst")).otherwise(F.col("src"))).where(~F.col("other").isin(primary, duplicate)).join(linked, "other", "left_anti")
    moved = moved.select(F.when(F.col("src") == duplicate, primary).otherwise(F.col("src")).alias("src"), "predicate", F.when(F.col("dst") == duplicate, primary).otherwise(F.col("dst")).alias("dst"), "confidence")
    return rest.select("src", "predicate", "dst", "confidence").unionByName(moved)


#: What a predicate is called from the other side.
INVERSES = {"teacher_of": "student_of", "student_of": "teacher_of", "incarnation_of": "has_incarnation", "wrote": "written_by", "cites": "cited_by", "within": "contains", "attended": "attended_by"}
SYMMETRIC = ("near", "contemporary_with", "located_at")


def inverse_edges(edges: DataFrame) -> DataFrame:
    """(id, src, predicate, dst, confidence): the edges seen from the other side, for predicates that have an inverse or are symmetric."""
    inverse = F.create_map(*[F.lit(x) for pair in INVERSES.items() for x in pair])
    symmetric = F.col("predicate").isin(list(SYMMETRIC))
    own = edges.where(symmetric | F.col("predicate").isin(list(INVERSES)))
    return own.select(
        F.concat("id", F.when(symmetric, "_symmetric").otherwise("_inverse")).alias("id"), F.col("dst").alias("src"), F.when(symmetric, F.col("predicate")).otherwise(F.element_at(inverse, F.col("predicate"))).alias("predicate"), F.col("src").alias("dst"), "confidence"
    )


def missing_inverse(edges: DataFrame, predicate: str = "teacher_of") -> DataFrame:
    """(src, dst): edges of the predicate whose inverse is not there."""
    there = of_types(edges, [INVERSES[predicate]]).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return of_types(edges, [predicate]).select("src", "dst").join(there, ["src", "dst"], "left_anti")


def _between(core: DataFrame) -> DataFrame:
    """(predicate, id): nodes of core (predicate, src, dst) that an edge leads to and one leads from."""
    end = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("out")))).alias("e")
    ends = core.select("predicate", end).groupBy("predicate", "e.id").agg(F.bool_or("e.out").alias("leads"), F.bool_and("e.out").alias("only"))
    return ends.where("leads and not only").select("predicate", "id")


def _peeled(core: DataFrame) -> DataFrame:
    """core (predicate, src, dst) without the nodes that nothing leads to, or that lead nowhere, again and again."""
    n = core.count()
    while n:
        on = materialised(_between(core))
        left = core.join(on.withColumnRenamed("id", "src"), ["predicate", "src"], "left_semi").join(on.withColumnRenamed("id", "dst"), ["predicate", "dst"], "left_semi")
        left = materialised(left.select("predicate", "src", "dst"))
        dropped(on, core)
        core, before, n = left, n, left.count()
        if n == before:
            break
    return core


def cycles(edges: DataFrame) -> DataFrame:
    """(predicate, id): nodes on a cycle of edges of one predicate, for all predicates together; an edge to itself is one.

    What peeling leaves is coloured: each node takes the least name that reaches it. A node that keeps its own name is the
    root of a strongly connected component, which is what reaches the root among nodes of its colour. These components
    are taken out and the rest is peeled and coloured again. Loops carry one row for each node or edge, never for each pair of nodes.
    Predicates none of whose nodes is both led to and led from, as between two kinds of nodes, are left out before edges are shuffled.
    """
    steps = materialised(edges.select("predicate", "src", "dst"))
    round_ = materialised(_between(steps).select("predicate").distinct())  # one row a predicate at most
    core, found = _peeled(materialised(steps.join(round_, "predicate", "left_semi").select("predicate", "src", "dst").distinct())), None
    dropped(steps)
    while not core.isEmpty():
        node = F.explode(F.array("src", "dst")).alias("id")
        colour = materialised(core.select("predicate", node).distinct().withColumn("colour", F.col("id")))
        while True:
            sent = core.join(colour.withColumnRenamed("id", "src"), ["predicate", "src"]).groupBy("predicate", F.col("dst").alias("id")).agg(F.min("colour").alias("sent"))
            new = colour.join(sent, ["predicate", "id"], "left").select("predicate", "id", F.least("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") < F.col("colour")).alias("moved"))
            new = materialised(new)
            colour = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        of = lambda end: colour.select("predicate", F.col("id").alias(end), "colour")
        inner = materialised(core.join(of("src"), ["predicate", "src"]).join(of("dst"), ["predicate", "dst", "colour"]).select("predicate", "src", "dst"))
        part = materialised(colour.where("id = colour").select("predicate", "id"))
        fresh = part
        while not fresh.isEmpty():
            back = inner.join(fresh.withColumnRenamed("id", "dst"), ["predicate", "dst"], "left_semi").select("predicate", F.col("src").alias("id")).distinct()
            fresh = materialised(back.join(part, ["predicate", "id"], "left_anti"))
            part = part.unionByName(fresh)
        part = materialised(part.join(colour, ["predicate", "id"]))
        large = part.groupBy("predicate", "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("predicate", "colour")
        loops = core.where("src = dst").select("predicate", F.col("src").alias("id"))
        on = part.join(large, ["predicate", "colour"], "left_semi").select("predicate", "id").unionByName(part.join(loops, ["predicate", "id"], "left_semi").select("predicate", "id")).distinct()
        on = materialised(on)
        found = on if found is None else found.unionByName(on)
        gone = part.select("predicate", "id")
        core = core.join(gone.withColumnRenamed("id", "src"), ["predicate", "src"], "left_anti").join(gone.withColumnRenamed("id", "dst"), ["predicate", "dst"], "left_anti")
        core = _peeled(materialised(core.select("predicate", "src", "dst")))
    return edges.select("predicate", F.col("src").alias("id")).limit(0) if found is None else found


def cycle_nodes(edges: DataFrame, predicate: str) -> DataFrame:
    """(id): nodes on a cycle of the predicate."""
    return cycles(of_types(edges, [predicate])).select("id")


def node_violations(nodes: DataFrame) -> DataFrame:
    """(id, violation): a row for each rule a node breaks: name, date order, ranges."""
    rules = {
        "missing_name": F.col("name").isNull() | (F.trim("name") == ""), "death_before_birth": F.col("death") < F.col("birth"), "long_life": F.col("death") - F.col("birth") > 80,
        "confidence_range": ~F.col("confidence").between(0, 1), "latitude_range": ~F.col("lat").between(-90, 90), "longitude_range": ~F.col("lon").between(-180, 180), "late_text": F.col("written") > 1880,
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in rules.items()]))
    return nodes.select("id", F.explode(broken).alias("violation"))


def flattened(nodes: DataFrame) -> DataFrame:
    """(id, properties): the node's filled columns as a map of texts."""
    cols = [c for c in nodes.columns if c != "id"]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in cols])
    return nodes.select("id", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("properties"))


def unflattened(flat: DataFrame, types: dict[str, str]) -> DataFrame:
    """(id, columns of types): the map of texts of flattened() as columns of these types again; what is not in the map is null."""
    return flat.select("id", *[F.try_element_at("properties", F.lit(c)).cast(t).alias(c) for c, t in types.items()])


def edge_violations(edges: DataFrame, predicates: list[str]) -> DataFrame:
    """(id, violation): a row for each rule an edge breaks: its ends, a known predicate, its confidence, no edge to itself."""
    rules = {
        "missing_source": F.col("src").isNull() | (F.trim("src") == ""), "missing_target": F.col("dst").isNull() | (F.trim("dst") == ""), "unknown_predicate": ~F.coalesce(F.col("predicate"), F.lit("")).isin(predicates),
        "confidence_range": ~F.col("confidence").between(0, 1), "self_loop": F.col("src") == F.col("dst"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in rules.items()]))
    return edges.select("id", F.explode(broken).alias("violation"))
