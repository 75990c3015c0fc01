"""The five-teacher chain and its neighbours: what the graph queries give on a graph small enough to read."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates as D
from lodestone.operators import graph as G
from lodestone.operators import relational as R
from lodestone.operators import validation as V

PEOPLE = [("tilopa", 988, 1069), ("naropa", 1016, 1100), ("marpa", 1012, 1097), ("milarepa", 1040, 1123), ("gampopa", 1079, 1153), ("drup", 1391, 1474), ("gyatso", 1475, 1542)]
EDGES = [
    ("tilopa", "teacher_of", "naropa", 0.98), ("naropa", "teacher_of", "marpa", 0.97), ("marpa", "teacher_of", "milarepa", 0.96), ("milarepa", "teacher_of", "gampopa", 0.95),
    ("gyatso", "incarnation_of", "drup", 0.9), ("milarepa", "wrote", "songs", 0.85), ("milarepa", "lived_at", "lhodrak", 0.88),
]


@pytest.fixture(scope="module")
def kg(spark):
    schema = "id string, type string, name string, tradition string, birth long, death long, founded long, occurred long, written long, lat double, lon double, confidence double, verified boolean, merge_status string"
    rows = [(i, "person", i, "kagyu", b, d, None, None, None, None, None, 0.9, True, "active") for i, b, d in PEOPLE]
    rows += [("songs", "text", "songs", None, None, None, None, None, 1100, None, None, 0.85, False, "active"), ("lhodrak", "place", "lhodrak", None, None, None, None, None, None, 28.2, 90.8, 0.9, True, "active"), ("lhasa", "place", "lhasa", None, None, None, None, None, None, 29.6519, 91.1315, 0.99, True, "active")]
    edges = spark.createDataFrame([(f"{p}:{s}:{d}", s, p, d, c) for s, p, d, c in EDGES], "id string, src string, predicate string, dst string, confidence double")
    return spark.createDataFrame(rows, schema), edges


def test_teachers(kg):
    r = G.teacher_lineage(kg[1], "milarepa").first()
    assert (r.root, r.depth, r.chain, r.confidence) == ("tilopa", 3, "tilopa>naropa>marpa>milarepa", 0.912576)
    assert G.teacher_lineage(kg[1], "tilopa").count() == 0


def test_students_need_inverse_edges(kg):
    inverse = G.inverse_edges(G.of_types(kg[1], ["teacher_of"]))
    r = G.student_lineage(inverse, "marpa").first()
    assert r.chain == "marpa>milarepa>gampopa"


def test_incarnations(kg):
    assert [r.id for r in G.incarnation_line(*kg, "drup").orderBy("position").collect()] == ["drup", "gyatso"]


def test_paths(kg):
    assert G.shortest_length(kg[1], "tilopa", "songs").first().length == 4
    assert G.shortest_length(kg[1], "tilopa", "drup").count() == 0
    assert G.shortest_paths(kg[1], "tilopa", "marpa").first().path == "tilopa>naropa>marpa"
    r = G.shortest_path(kg[1], "tilopa", "songs").first()
    assert (r.path, r.length, r.confidence) == ("tilopa>naropa>marpa>milarepa>songs", 4, 0.775690)
    assert G.shortest_path(kg[1], "tilopa", "drup").count() == 0


def test_network(kg):
    paths = G.network_paths(*kg, "milarepa", 2)
    assert {r.id: r.hops for r in G.network(*kg, "milarepa", 2).collect()} == {"marpa": 1, "naropa": 2, "gampopa": 1, "songs": 1, "lhodrak": 1}
    assert {r.id for r in G.network_edges(paths).collect()} == {f"{p}:{s}:{d}" for s, p, d, _ in EDGES[2:4] + EDGES[5:]}
    r = G.network_summary(paths).first()
    assert (r.nodes, r.edges, r.confidence) == (5, 4, 0.92)


def test_components_and_cycles(kg, spark):
    n = G.components(*kg).groupBy("component").count().collect()
    assert sorted(r["count"] for r in n) == [1, 2, 7]
    loop = spark.createDataFrame([("1", "a", "cites", "b", 1.0), ("2", "b", "cites", "c", 1.0), ("3", "c", "cites", "a", 1.0), ("4", "x", "cites", "a", 1.0)], kg[1].schema)
    assert {r.id for r in G.cycle_nodes(loop, "cites").collect()} == {"a", "b", "c"}


def test_cycles_of_a_random_graph(spark):
    """Against reachability of all pairs; a cycle counts within one predicate only."""
    import random

    draw = random.Random(3)
    edges = {(draw.choice("pq"), f"n{draw.randrange(40):02}", f"n{draw.randrange(40):02}") for _ in range(90)} | {("r", "z", "z"), ("r", "z", "y")}
    reach = {p: {(a, b) for q, a, b in edges if q == p} for p in "pqr"}
    for pairs in reach.values():
        while more := {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs:
            pairs |= more
    df = spark.createDataFrame([("", a, p, b, 1.0) for p, a, b in edges], "id string, src string, predicate string, dst string, confidence double")
    got = {(r.predicate, r.id) for r in G.cycles(df).collect()}
    assert got == {(p, a) for p, pairs in reach.items() for a, b in pairs if a == b} and len(got) > 5
    assert G.cycles(df.limit(0)).count() == 0


def test_whole_graph_queries(spark):
    from collections import Counter

    from lodestone import registry
    from lodestone.sources.views import kg_edges, kg_nodes
    from tests.conftest import SF

    ids = [r.id for r in kg_nodes(spark, SF).select("id").collect()]
    edges = [(r.src, r.dst) for r in kg_edges(spark, SF).select("src", "dst").collect()]
    near = {i: {i} for i in ids}
    for a, b in edges:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    root, label = {}, {i: i for i in ids}
    for first in sorted(near):
        todo = [] if first in root else [first]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = first
                todo += near[x]
    q = registry.queries()
    assert {r.id: r.component for r in G.components(kg_nodes(spark, SF), kg_edges(spark, SF)).collect()} == {i: root[i] for i in ids}
    for _ in range(5):
        votes = {i: Counter(label[j] for j in near[i] if j in label) for i in near}
        label = {i: min(v, key=lambda k: (-v[k], k)) for i, v in votes.items() if v}
    assert {r.id: r.community for r in q["gr15_label_propagation"](spark, SF).collect()} == label


def test_near_places(kg):
    assert [r.id for r in G.nearby(kg[0], 29.0, 91.0, 150).collect()] == ["lhasa", "lhodrak"]


def test_validation(kg):
    assert V.type_issues(*kg).count() == 0
    assert V.temporal_issues(*kg).where("issue = 'TEACHER_YOUNGER_THAN_STUDENT'").first().id == "teacher_of:naropa:marpa"
    confidence = {r.id: r.confidence for r in V.adjusted_confidence(*kg).collect()}
    assert confidence["teacher_of:naropa:marpa"] == 0.485


def test_merge_moves_only_unlinked_edges(kg):
    out = G.merge_rewire(kg[1], "marpa", "milarepa").select("src", "dst").collect()
    assert {tuple(r) for r in out} == {("tilopa", "naropa"), ("naropa", "marpa"), ("marpa", "gampopa"), ("gyatso", "drup"), ("marpa", "songs"), ("marpa", "lhodrak")}


def test_upsert_and_diff(kg):
    base = kg[0].select("id", "name")
    changed = R.upsert(base, base.where("id = 'marpa'").withColumn("name", F.lit("MARPA")), ["id"])
    assert changed.where("name = 'MARPA'").count() == 1 and changed.count() == base.count()
    assert R.id_diff(base, base.where("id <> 'marpa'")).first().side == "left_only"
    assert [r.field for r in R.property_mismatches(base, changed, ["name"]).collect()] == ["name"]


def test_dates_of_signs_eras_and_lives(spark):
    texts = ["in the Sakya period", "early Sakya Period", "the end of the Rinpung Period", "summer of 1050", "fire rabbit year", "wood tiger", "no date"]
    got = {r.t: (r.r.year, r.r.rule, r.r.confidence) if r.r else None for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.resolve_date(F.col("t")).alias("r")).collect()}
    assert got == {"in the Sakya period": (1311, "era", 0.63), "early Sakya Period": (1285, "era", 0.72), "the end of the Rinpung Period": (1539, "era", 0.64), "summer of 1050": (1050, "season", 0.95), "fire rabbit year": (1447, "element-animal", 0.6), "wood tiger": (1446, "element-animal", 0.6), "no date": None}
    near = spark.createDataFrame([("Iron-Monkey year", 1100), ("fire rabbit", 1086)], "t string, y long").select(D.sign_year(F.col("t"), F.col("y")).alias("s")).collect()
    assert [(r.s.year, r.s.confidence) if r.s else None for r in near] == [(1116, 0.8), (1087, 0.8)]
    people = spark.createDataFrame([("Marpa", 1012, 1097), ("marpa", 1500, None)], "name string, birth long, death long")
    told = spark.createDataFrame([(1, "after Marpa died"), (2, "3 years after Marpa died"), (3, "before Marpa was born"), (4, "5 years after MARPA was born"), (5, "after Nobody died"), (6, None)], "id long, text string")
    assert {r.id: r.rel and r.rel.year for r in D.relative_dates(told, people).collect()} == {1: 1098, 2: 1100, 3: 1011, 4: 1017, 5: None, 6: None}
    assert told.select(D.at_age(F.lit("At age 40 they left"), F.lit(1012)).alias("y"), D.age(F.lit(1012), F.lit(1000)).alias("a")).first().asDict() == {"y": 1052, "a": None}


def test_dates(spark):
    got = {r.t: r.y for r in spark.createDataFrame([("1012",), ("500",), ("mid-11th century",), ("early 12th century",), ("late 13th century",), ("Rabjung 14, year 30",), ("soon",)], "t string").select("t", D.resolve_date(F.col("t")).alias("r")).select("t", F.col("r.year").alias("y")).collect()}
    assert got == {"1012": 1012, "500": None, "mid-11th century": 1050, "early 12th century": 1120, "late 13th century": 1280, "Rabjung 14, year 30": 1836, "soon": None}


def test_shortest_paths_are_not_listed(spark):
    # 20 diamonds in a row: 2**20 shortest paths, the ten best of which differ in few places.
    edges = []
    for i in range(20):
        for side, c in (("x", 0.9), ("y", 0.8)):
            edges += [(f"n{i:02d}", f"{side}{i:02d}", c), (f"{side}{i:02d}", f"n{i + 1:02d}", 1.0)]
    df = spark.createDataFrame([(f"{a}{b}", a, "p", b, c) for a, b, c in edges], "id string, src string, predicate string, dst string, confidence double")
    got = G.shortest_paths(df, "n00", "n20", 40, 10).collect()
    assert len(got) == 10 and got[0].length == 40 and "y" not in got[0].path and [r.path.count("y") for r in got[1:]] == [1] * 9
    assert [r.path for r in got[1:]] == sorted(r.path for r in got[1:]) and got[1].path.index("y") > got[0].path.index("x19") - 5
    assert G.shortest_length(df, "n20", "x03", 40).first().length == 33 and G.shortest_length(df, "n00", "n20", 39).count() == 0
    assert G.shortest_paths(df, "n00", "nobody").count() == 0 and G.shortest_paths(df, "n00", "n00").count() == 0


def test_best_chain_equals_all_chains_with_and_without_cycles(spark):
    import random

    rng = random.Random(7)
    for circles in (False, True):
        ids = [f"t{i:02d}" for i in range(24)]
        edges = [(b, a, rng.choice((0.5, 0.8, 0.9))) for i, a in enumerate(ids) for b in rng.sample(ids[i + 1 :], min(3, len(ids) - i - 1))]  # b teaches a
        if circles:
            edges += [(ids[2], ids[9], 1.0), (ids[5], ids[20], 1.0)]
        df = spark.createDataFrame([(f"{a}{b}", a, "teacher_of", b, c) for a, b, c in edges], "id string, src string, predicate string, dst string, confidence double")
        taught, best = {b for _, b, _ in edges}, None

        def walk(path, c):
            nonlocal best
            if path[-1] not in taught and len(path) > 1:
                key = (-c, len(path), ">".join(path))
                best = min(best, key) if best else key
            if len(path) <= 6:
                for a, b, w in edges:
                    if b == path[-1] and a not in path:
                        walk([*path, a], c * w)

        walk([ids[0]], 1.0)
        got = G.teacher_lineage(df, ids[0], 6).collect()
        assert [(r.depth, r.confidence, r.chain) for r in got] == ([(best[1] - 1, round(-best[0], 6), ">".join(reversed(best[2].split(">"))))] if best else [])
    assert G.student_lineage(df.limit(0), "t00").count() == 0


def test_cycles_carry_no_edges_between_two_kinds_of_nodes(spark, monkeypatch):
    rows = [("wrote", f"s{i % 3}", f"p{i}") for i in range(20)] + [("cites", "p1", "p2"), ("cites", "p2", "p1"), ("cites", "p2", "p3")]
    steps, real = [], G.materialised
    monkeypatch.setattr(G, "materialised", lambda df: steps.append(real(df)) or steps[-1])
    monkeypatch.setattr(G, "dropped", lambda *_: None)
    assert {tuple(r) for r in G.cycles(spark.createDataFrame(rows, "predicate string, src string, dst string")).select("predicate", "id").collect()} == {("cites", "p1"), ("cites", "p2")}
    assert [df.count() for df in steps][:3] == [23, 1, 3]


def test_all_checks_read_edges_once(spark):
    from lodestone.sources.views import dated_edges, kg_nodes
    from tests.conftest import SF

    read = V.checked(kg_nodes(spark, SF), dated_edges(spark, SF)).inputFiles()
    assert read and not [f for f in read if "lineitem" in f]
