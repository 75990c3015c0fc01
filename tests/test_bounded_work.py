"""Steps whose work was out of proportion: the same results, from less."""

import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import checks as C
from lodestone.functions import text as X
from lodestone.operators import communities as M
from lodestone.operators import containment as H
from lodestone.operators import examples as T
from lodestone.operators import graph as K
from lodestone.operators import layout as L
from lodestone.operators import propagation as P
from lodestone.operators import resolution as E
from lodestone.operators import segments as S
from lodestone.operators import signals as G
from lodestone import session as Z
from lodestone.operators import relational as R
from lodestone.plans.method_queries import _coded, _decoded
from lodestone.session import materialised
from lodestone.sources.views import kg_edges, kg_nodes
from tests.conftest import SF
from tests.test_methods import plain_louvain


def test_fitting_prefix_equals_the_plain_search(spark):
    texts = ["", "a", " a  b c ", "\n\na b", "é " * 60, "éé x " * 40, "é" * 50, "w " * 5000, "é\t" * 9 + "long tail of words", "éb " * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    estimate = lambda t: math.ceil(sum(c == "é" for c in t) / 4) + math.ceil(len(t.replace("é", " ").split()) * 1.3)
    for budget in (0, 1, 5, 20):
        for r in rows.select("t", C.fitting_prefix(F.col("t"), budget, "é").alias("p")).collect():
            import re

            words = re.split(r"\s+", r.t.strip(" "))
            assert r.p == " ".join(words[: max(n for n in range(len(words) + 1) if estimate(" ".join(words[:n])) <= budget)]), (r.t, budget)
    limit = next(a for a in str(C.fitting_prefix(F.col("t"), 5, "é")._jc).replace(")", ",").split(",") if a.strip() == "23")
    assert limit  # the text is split to no more words than the budget can take


def test_value_of_distinct_rows_is_worked_out_once(spark):
    rows = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(300)], "i int, v string")
    seen = spark.sparkContext.accumulator(0)
    slow = F.udf(lambda v: (seen.add(1), f"{v}!")[1])
    got = E.of_distinct(rows, "v", slow("v"), "w").collect()
    assert {(r.i, r.w) for r in got} == {(i, f"{[None, 'a', 'b'][i % 3]}!") for i in range(300)}
    assert seen.value == 3


def test_inert_characters_are_in_normal_form(spark):
    ranges = ((0, 0x2FF), (0x400, 0x482), (0x2010, 0x2027), (0x4E00, 0x9FFF))
    assert all(not unicodedata.combining(chr(c)) and unicodedata.is_normalized("NFC", chr(c)) for a, b in ranges for c in range(a, b + 1))
    texts = ["plain", "é — “x”", "é", "é and é", "Å", None, "가"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", X.normal_form(F.col("t")).alias("f")).collect()
    for r in got:
        nfc = unicodedata.normalize("NFC", r.t or "")
        assert (r.f.text, r.f.composed, r.f.mixed) == (nfc, nfc == (r.t or ""), r.t == "é and é")


def test_text_of_documents_in_one_range_is_shuffled_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(S, "materialised", lambda df: (kept.extend(df.columns), materialised(df))[1])
    pages = spark.createDataFrame([(d, p, f"one {d}. two (x. {p}") for d in range(9) for p in range(5)], "doc_id long, page long, text string")
    for made in (S.sentences(pages), S.chunks(pages, 9)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan
        assert made.count() >= 9
    assert not {"text", "piece", "sentence"} & set(kept)
    ends = spark.createDataFrame([(1.0, 0, "a \u0085 \n"), (1.0, 1, " b. "), (2.0, 0, " \t\n"), (None, 7, "x"), (float("nan"), 3, "y."), (float("nan"), 4, "z")], "doc_id double, page int, text string")
    got = sorted((str(r.doc_id), r.pos, r.sentence) for r in S.sentences(ends).collect())
    assert got == [("1.0", 0, "a \u0085 \n  b."), ("None", 0, "x"), ("nan", 0, "y."), ("nan", 1, "z")]


def test_merge_and_undo_carry_an_edge_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(G, "materialised", lambda df: (kept.append(df.columns), materialised(df))[1])
    nodes = spark.createDataFrame([(x, "active") for x in "abcd"], "id string, merge_status string")
    edges = spark.createDataFrame([("1", "a", "t", "b", 0.9), ("2", "b", "t", "d", None), ("3", "a", "t", "d", 0.7), ("5", None, "t", "b", 0.1), ("6", None, "t", "c", 0.1), ("7", "a", "t", "d", 0.9)], "id string, src string, predicate string, dst string, confidence double")
    after = G.merge_applied(nodes, edges, spark.createDataFrame([("a", "b")], "primary string, duplicate string"))
    assert {tuple(r) for r in after[1].collect()} == {("6", None, "t", "c", 0.1), ("7", "a", "t", "d", 0.9)}
    back = G.merge_undone(*after)
    assert sorted(map(repr, back[1].collect())) == sorted(map(repr, edges.collect()))
    assert not any("before" in c for c in kept)  # edges were in the table twice
    assert back[1]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_items_of_pages_are_shuffled_once(spark):
    rows = [(d, p, n, "w", float(50 + n % 3 * (60 + 40 * d) + n % 2), 700.0 - n, None if n == 4 else 30.0, 10.0) for d in range(4) for p in range(3) for n in range(3 + 9 * p)]
    pages = L.column_layout(spark.createDataFrame(rows, "doc_id long, page long, n long, text string, x double, y double, width double, height double"))
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    assert pages.count() == 12


def test_labels_go_in_packets(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(P, "materialised", lambda df: (kept.append(materialised(df)), kept[-1])[1])
    monkeypatch.setattr(P, "dropped", lambda *tables: None)
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(60)]
    edges = [(rng.choice(ids[:50] + ["x1", "x2"]), rng.choice(ids[:50])) for _ in range(90)] + [("n3", "n3"), ("x1", "x1"), ("n4", "n3"), ("n4", "n3"), ("n3", "n4"), (None, "n3"), ("n5", None)]
    near = {i: Counter() for i in [*ids, "x1", "x2"]}
    for a, b in {p for a, b in edges if a and b for p in ((a, b), (b, a))}:
        near[a][b] += 1
    for i in ids:
        near[i][i] += 1
    label = {i: i for i in ids}
    for _ in range(3):
        votes = {i: Counter() for i in near}
        for i in near:
            for j, n in near[i].items():
                if j in label:
                    votes[i][label[j]] += n
        label = {i: min(v, key=lambda k: (-v[k], k)) for i, v in votes.items() if v}
    nodes = spark.createDataFrame([(i,) for i in [*ids, "n7"]], "id string")
    got = K.label_propagation(nodes, spark.createDataFrame([(a, "t", b) for a, b in edges], "src string, predicate string, dst string"), rounds=3).collect()
    assert len(got) == len(label) and {r.id: r.community for r in got} == label
    number = lambda i: None if i is None else -int(i[1:]) * 2 ** (40 if i[0] == "x" else 1)
    nodes = spark.createDataFrame([(number(i), i) for i in ids], "id long, name string")
    got = K.label_propagation(nodes, spark.createDataFrame([(number(a), "t", number(b)) for a, b in edges], "src long, predicate string, dst long"), ["t"], 3, "name").collect()
    assert {r.id: r.community for r in got} == {number(i): c for i, c in label.items()}
    assert all(t.count() <= 8 for t in kept if "packet" in t.columns) and sum("packet" in t.columns for t in kept) == 8
    assert not any("other" in t.columns for t in kept)  # a row for each edge before, shuffled three times a round
    none = K.label_propagation(nodes.limit(0), spark.createDataFrame([], "src long, predicate string, dst long"), label="name")
    assert none.collect() == []
    alone = K.label_propagation(nodes, spark.createDataFrame([], "src long, predicate string, dst long"), label="name").collect()
    assert {r.community for r in alone} == set(ids)
    plan = K.label_propagation(nodes, spark.createDataFrame([(1, "t", 2)], "src long, predicate string, dst long"), rounds=1, label="name")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan  # labels are not broadcast by the size of their packets


def test_orphaned_edges_meet_ids_in_bounded_partitions(spark, monkeypatch):
    nodes, edges = kg_nodes(spark, SF).where("id not like '%7'"), kg_edges(spark, SF)
    extra = spark.createDataFrame([("e1", None, "c1"), ("e1", None, "c1"), ("e2", "c7", None), ("e3", "c1", "c2")], "id string, src string, dst string")
    edges = edges.select("id", "src", "dst").unionByName(extra)
    there = {r.id for r in nodes.select("id").collect()}
    reason = {(False, False): "both", (False, True): "subject", (True, False): "object"}
    want = sorted((r.id, reason[r.src in there, r.dst in there]) for r in edges.collect() if not (r.src in there and r.dst in there))
    for part in (Z.PART_BYTES, 5_000):
        monkeypatch.setattr(Z, "PART_BYTES", part)
        n = Z.partitions(edges)
        got = R.orphaned_edges(nodes, edges)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2, plan
        assert (n > 4) == (part == 5_000) and plan.count(f", {n}), REPARTITION_BY_NUM") == (2 if n > 4 else 0), plan
        assert sorted((r.id, r.reason) for r in got.collect()) == want


def test_edges_are_counted_in_bounded_partitions(spark, monkeypatch):
    plain = sorted(map(repr, kg_edges(spark, SF).collect()))
    best = K.most_influential(kg_nodes(spark, SF), kg_edges(spark, SF)).collect()
    monkeypatch.setattr(Z, "PART_BYTES", 5_000)
    edges = kg_edges(spark, SF)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2, plan  # lines by supplier and part, lines by order and part
    assert sorted(map(repr, edges.collect())) == plain
    seen, before = [], spark.conf.get(Z.PARTITIONS)
    monkeypatch.setattr(K, "materialised", lambda df, **how: (seen.append(how), materialised(df, **how))[1])
    got = K.most_influential(kg_nodes(spark, SF), edges).collect()
    assert [r[:4] for r in got] == [r[:4] for r in best]
    assert all(abs(a.influence - b.influence) < 2e-4 for a, b in zip(got, best, strict=True))  # sums of doubles, in another order
    assert seen == [{"finely": True}] and spark.conf.get(Z.PARTITIONS) == before


def test_louvain_has_no_row_for_each_edge(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(M, "materialised", lambda df: (kept.append(materialised(df)), kept[-1])[1])
    monkeypatch.setattr(M, "dropped", lambda *tables: None)
    assert all(int(M._turn(np.array([zlib.crc32(b"c17:")]), n)[0]) == zlib.crc32(b"c17:%d" % n) for n in (0, 9, 10, 123))
    rng = random.Random(7)
    ids = [f"{k}{i}" for k in "cp" for i in (0, 1, 2, 9, 10, 11, 90, 99, 100, 9_999_999_999)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)] + [("c1", "c1"), ("c2", None), ("c5", "c5"), ("p7", "c7")]
    nodes = spark.createDataFrame([(i,) for i in [*ids, "c5", "c8", "p7"]], "id string")
    rows = spark.createDataFrame([(a, "t", b) for a, b in edges], "src string, predicate string, dst string")
    plain = {r.id: r.community for r in M.louvain(nodes, rows).collect()}
    assert all(t.count() <= 80 for t in kept if "packet" in t.columns) and any("packet" in t.columns for t in kept)
    kept.clear()
    assert {r.id: r.community for r in M.louvain(nodes, rows, code=(_coded, _decoded)).collect()} == plain  # c7 is no node
    assert plain["c8"] == "c8" and plain["p7"] == "c7" and all("packet" in t.columns or set(t.columns) == {"id", "first"} for t in kept)
    back = nodes.select("id", _coded(F.col("id")).alias("n"), _decoded(_coded(F.col("id"))).alias("b")).orderBy("n").collect()
    assert [r.b for r in back] == [r.id for r in back] == sorted(r.id for r in back)
    heavy = rows.withColumn("n", F.when(F.col("src") < "c9", F.lit(2**40)).otherwise(1))  # squares are over 64 bits
    want, _ = plain_louvain([r.id for r in nodes.collect()], [(a, b, 2**40 if a < "c9" else 1) for a, b in edges])
    assert {r.id: r.community for r in M.louvain(nodes, heavy, None, "n").collect()} == want


def test_examples_by_keywords_make_no_row_for_each_pair_that_shares_a_word(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(T, "materialised", lambda df: (kept.append(materialised(df)), kept[-1])[1])
    monkeypatch.setattr(T, "HELD", 60)
    monkeypatch.setattr(T, "AT_ONCE", 7)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    pick = lambda n: ["all", *rng.choices([*words, None], k=n)]
    asked = [(i, None, pick(rng.randint(0, 9)) if i % 5 else ["nobody's", None]) for i in range(40)]
    held = [(i, rng.choice(["a", "b", None]), None, pick(5) if i % 7 else None) for i in range(150)]
    inputs = spark.createDataFrame(asked, "query_id long, embedding array<double>, keywords array<string>")
    library = spark.createDataFrame(held, "example_id long, category string, embedding array<double>, keywords array<string>")
    got = T.select_examples(inputs, library, 4, prefer="b").where("way = 'keywords'").collect()
    want = set()
    for q, _, kw in asked:
        if not q % 5:
            continue
        scored = [(round(sum(w is not None and w in set(h or ()) for w in kw) / len(kw), 9), e, c) for e, c, _, h in held]
        ranked = sorted((-round(s * 1.2, 9) if c == "b" else -s, e, c) for s, e, c in scored)
        seen, placed = Counter(), []
        for x, e, c in ranked:
            seen[c] += 1
            placed.append((seen[c] > 2, x, e))
        want |= {(q, i, e) for i, (_, _, e) in enumerate(sorted(placed)[:4], 1)}
    assert {(r.query_id, r.place, r.example_id) for r in got} == want
    assert kept[-1].count() <= 40 * 3 * 4 * 3  # queries, blocks, best of a category, categories; 4,000 rows before


def test_contained_patterns_need_no_join_with_their_texts(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 200)  # many blocks of patterns
    monkeypatch.setattr(H, "SLICE", 64)
    rng = random.Random(9)
    word = lambda most: "".join(rng.choice("aabé") for _ in range(rng.randint(0, most)))
    patterns = sorted({word(22) for _ in range(60)})
    texts = [(i // 2 if i % 9 else None, word(150) if i % 7 else None) for i in range(60)]
    t, p = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(x,) for x in [*patterns, None]], "term string")
    found = H.contained(t, p, "doc_id", "text", "term")
    assert {tuple(r) for r in found.collect()} == {(i, x) for i, text in texts for x in patterns if x and x in (text or "")}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # each text met each of its patterns in a join before
    n = Counter((i, x, sum(text.startswith(x, j) for j in range(len(text)))) for i, text in texts if text for x in patterns if x and x in text)
    assert Counter(tuple(r) for r in H.contained_terms(t, p).collect()) == n
