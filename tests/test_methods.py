"""Communities, vector memory, containment, aligned sentences and chunks, against plain versions that share no code with them."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import alignment as A
from lodestone.operators import communities as C
from lodestone.operators import containment as K
from lodestone.operators import memory as V
from lodestone.operators import segments as S
from lodestone.session import CLEAN, materialised


def plain_louvain(ids, edges, max_levels=10, max_rounds=8):
    """The same moves with dictionaries; modularity as fractions. Also the modularity after each level."""
    w = defaultdict(int)
    for a, b, n in edges:
        if a is not None and b is not None and n > 0:
            w[a, b] += n
            w[b, a] += n
    m2, member, seen = sum(w.values()), {a: a for a, _ in w}, []
    k = lambda: {x: sum(n for (a, _), n in w.items() if a == x) for x in {a for a, _ in w}}

    def quality(c, deg):
        total = Counter()
        for x, n in deg.items():
            total[c[x]] += n
        return Fraction(sum(n for (a, b), n in w.items() if c[a] == c[b]), m2) - sum(Fraction(t * t, m2 * m2) for t in total.values())

    for level in range(max_levels if m2 else 0):
        deg = k()
        c, parts, still, begun = {x: x for x in deg}, 2, 0, False
        seen.append(quality(c, deg))
        for r in range(max_rounds):
            total, moves = Counter(), {}
            for x, n in deg.items():
                total[c[x]] += n
            for x in deg:
                if zlib.crc32(f"{x}:{level}".encode()) % parts != r % parts:
                    continue
                near = Counter({c[x]: 0})
                for (a, b), n in w.items():
                    if a == x and b != x:
                        near[c[b]] += n
                gain = {t: m2 * n - deg[x] * (total[t] - (deg[x] if t == c[x] else 0)) for t, n in near.items()}
                to = min(gain, key=lambda t: (-gain[t], t))
                if gain[to] > gain[c[x]]:
                    moves[x] = to
            new = c | moves
            gain = quality(new, deg) - quality(c, deg)
            if moves and gain > 0:
                c, still, begun = new, still + 1 if gain < Fraction(1, 1000) else 0, True
            elif not moves:
                still += 1
            elif parts >= 4:
                break
            else:
                parts, still = 2 * parts, 0
            if still >= parts:
                break
        if not begun:
            break
        name = {t: min(x for x in c if c[x] == t) for t in set(c.values())}
        member = {x: name[c[at]] for x, at in member.items()}
        new_w = defaultdict(int)
        for (a, b), n in w.items():
            new_w[name[c[a]], name[c[b]]] += n
        w = new_w
    first = {}
    for x, at in member.items():
        first[at] = min(first.get(at, x), x)
    return {x: first[member[x]] if x in member else x for x in ids}, seen


def test_louvain_equals_the_plain_version_and_never_loses_modularity(spark):
    rng = random.Random(4)
    ids = [f"v{i:03d}" for i in range(200)]
    edges = [(ids[i], ids[j], rng.randint(1, 3)) for i in range(190) for j in range(i) if rng.random() < (0.25 if i // 20 == j // 20 else 0.004)]
    edges += [(ids[3], ids[3], 2), (None, ids[4], 1), (ids[5], ids[6], 0)]
    df = spark.createDataFrame([("e", a, "p", b, n) for a, b, n in edges], "id string, src string, predicate string, dst string, n int")
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    want, seen = plain_louvain(ids, edges)
    found = C.louvain(nodes, df, None, "n")
    assert {r["id"]: r["community"] for r in found.collect()} == want
    assert seen == sorted(seen) and len(set(want.values())) < 40
    assert C.modularity(df, found, None, "n") == pytest.approx(float(max(seen)), abs=1e-9) and float(max(seen)) > 0.6
    assert C.louvain(nodes, df.limit(0)).where("id <> community").count() == 0 and C.modularity(df.limit(0), found) == 0.0


def test_finished_steps_leave_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, kept = files(), spark.conf.get(CLEAN)
    steps = [materialised(spark.range(50_000).groupBy((F.col("id") % 1000 + i).alias("k")).count()) for i in range(5)]
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(CLEAN) == kept and all(x.count() == 1000 for x in steps)


def test_memory_finds_the_most_alike_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 6))
    rows = [(i, base[i].tolist()) for i in range(300)] + [(i, base[0].tolist()) for i in range(300, 420)] + [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6)]
    asked = [(i, (base[i % 300] + rng.normal(size=6) * rng.choice([0.0, 0.3, 0.8])).tolist()) for i in range(500)] + [(600, None), (601, [0.0] * 6)]
    kind = "vec_id long, embedding array<double>"
    memory, queries = spark.createDataFrame(rows, kind), spark.createDataFrame(asked, kind)
    real = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and np.isfinite(v).all() and any(v)]
    m, at = np.array([v for _, v in real]), np.array([i for i, _ in real])
    for least in (0.95, 0.5, 1.0):
        want = {}
        for i, v in asked:
            if v and any(v):
                sims = np.round(m @ (np.array(v) / np.linalg.norm(v)), 9)
                if sims.max() >= least:
                    want[i] = int(at[sims == sims.max()].min())
        found = V.best_matches(queries, memory, least, pivots=16)
        assert {r["query_id"]: r["vec_id"] for r in found.collect()} == want and want
        h = V.hit_rates(queries, memory, found).first()
        assert (h["asked"], h["hits"], h["misses"], h["entries"]) == (502, len(want), 502 - len(want), 423)
    assert V.best_matches(queries, memory.limit(0)).count() == 0 and V.best_matches(queries.limit(0), memory).count() == 0


def test_memory_meets_only_blocks_that_can_hold_a_match(spark):
    rng = np.random.default_rng(9)
    centre = np.repeat(rng.normal(size=(12, 6)), 40, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(centre + rng.normal(size=centre.shape) * 0.05)] + [(480 + i, centre[0].tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(i, int(np.round(u @ u[i], 9).argmax()), 1.0) for i in range(len(u))}
    assert {tuple(r) for r in V.best_matches(df, df, asked_block=20, stored_block=30).collect()} == want
    one = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))  # each query has 4,000 matches
    assert V.best_matches(one, one).where("query_id <> vec_id").count() == 0


def test_containment_of_many_patterns_equals_looking_for_each(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abé \n།") for _ in range(n))
    texts = [(i, text(rng.choice((0, 5, 60, 400)))) for i in range(120)] + [(None, "zz zebra crossing"), (7, "more of seven: zebra"), (200, None), (201, "x" * 50_000 + "needle in it")]
    patterns = [text(rng.randint(1, 12)) for _ in range(300)] + ["zebra", "zebra crossing", "zebra crossings", "needle in it", "", None, "x" * 300, texts[20][1]]
    t, p = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(x,) for x in patterns] * 2, "term string")
    got = {tuple(r) for r in K.contained(t, p, "doc_id", "text", "term").collect()}
    assert got == {(i, x) for i, s in texts for x in patterns if x and s and x in s}
    counts = K.contained_terms(spark.createDataFrame([(1, "aaa bab"), (2, None), (None, r"ab \E(")], "doc_id long, text string"), spark.createDataFrame([("aa",), ("ab",), (r"\E(",), (None,), ("",)], "term string"))
    assert {tuple(r) for r in counts.collect()} == {(1, "aa", 2), (1, "ab", 1), (None, "ab", 1), (None, r"\E(", 1)}
    assert K.contained(t, p.limit(0), "doc_id", "text", "term").count() == 0 == K.contained(t.limit(0), p, "doc_id", "text", "term").count()


def test_references_stand_in_the_text_or_hold_its_head(spark):
    passages = [(1, "general words"), (2, "the empty view of all things"), (3, "all things"), (4, "things"), (5, "of all"), (6, "")]
    texts = [(1, "here all things of all kinds"), (2, "the empty view of all things and more"), (3, "nothing fits"), (4, ""), (5, None), (6, "the empty view of al")]
    got = defaultdict(list)
    for r in sorted(K.references(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(passages, "passage_id long, source string")).collect()):
        got[r["text_id"]].append(r["passage_id"])
    plain = {}
    for i, t in texts:
        t = t or ""
        met = [k for k, s in passages if s and (s in t or t and t[:20] in s)]
        plain[i] = (met or [1, 2, 3])[:3]
    assert dict(got) == plain


def test_alignment_has_the_highest_sum_and_keeps_the_order():
    rng = np.random.default_rng(1)
    for _ in range(60):
        like = np.round(rng.random((rng.integers(1, 6), rng.integers(1, 6))), 2) * (rng.random() < 0.9)

        def best(i, j, like=like):
            return 0.0 if not i or not j else max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + like[i - 1, j - 1])

        at = A.aligned(like)
        pairs = [(i, j) for i, j in enumerate(at) if j >= 0]
        assert all(a < b for (_, a), (_, b) in zip(pairs, pairs[1:]))
        assert sum(like[i, j] for i, j in pairs) == pytest.approx(best(*like.shape))


def test_consensus_by_aligned_sentences(spark):
    base = [("a", "The lama came here (བླ་མ). It rained all day long. All left. Nothing else happened then.", 0.6), ("b", "Alone stands this.", 0.5), ("c", "Weak helpers only.", 0.5), ("d", None, 0.4)]
    helpers = [("a", "h1", "Once upon a time. The lama came here. It rained all day. Nobody stayed.", 0.9), ("a", "h2", "It rained all day long. All left.", 0.7), ("a", "h3", "Ignored entirely.", 0.2), ("c", "h1", "Weak helpers only.", 0.1), ("c", "h2", "  ", 0.9), ("d", "h1", "Words.", 0.9)]
    got = {r["key"]: r for r in A.consensus(spark.createDataFrame(base, "key string, text string, confidence double"), spark.createDataFrame(helpers, "key string, helper string, text string, confidence double")).collect()}
    # h1's words with the original, then twice all words of h2, which is not sure enough to be taken, then no counterpart.
    agreement = (1 + 0.8 + 0.8 + 1) / 4
    assert got["a"]["text"] == "The lama came here. (བླ་མ) It rained all day long. All left. Nothing else happened then." and got["a"]["agreement"] == pytest.approx(agreement, abs=1e-6)
    assert got["a"]["confidence"] == pytest.approx(min(0.98, 0.4 * 0.6 + 0.6 * 0.8 + 0.2 * agreement), abs=1e-6)
    assert (got["b"]["agreement"], got["b"]["confidence"], got["c"]["confidence"], got["c"]["text"]) == (1.0, 0.5, 0.45, "Weak helpers only.")
    assert got["d"]["text"] is None
    placed = A.by_place(A.likeness(["a b c.", "x (ཀ).", "d e f."], ["q."]), ["a b c.", "x (ཀ).", "d e f."], ["q."])
    assert placed == [0, -1, -1]


def plain_edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, before = [i] + [0] * len(b), d
        for j, y in enumerate(b, 1):
            d[j] = min(before[j] + 1, d[j - 1] + 1, before[j - 1] + (x != y))
    return d[-1]


def test_token_edits_and_text_likeness(spark):
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randint(0, 40))]
        b = [rng.randrange(5) for _ in range(rng.randint(0, 60))] if rng.random() < 0.5 else [x if rng.random() < 0.8 else 9 for x in a if rng.random() < 0.9]
        assert A.token_edits(a, b) == plain_edits(a, b)
    one = spark.createDataFrame([("Red fox, red FOX.", "red fox jumps"), (None, ""), ("x", None)], "a string, b string").select(A.texts_alike(F.col("a"), F.col("b")).alias("s")).collect()
    g, h = Counter("red fox, red fox."[i : i + 3] for i in range(15)), Counter("red fox jumps"[i : i + 3] for i in range(11))
    cosine = sum(n * h[k] for k, n in g.items()) / math.sqrt(sum(n * n for n in g.values()) * sum(n * n for n in h.values()))
    assert one[0].s.likeness == pytest.approx(0.5 * 2 / 3 + 0.3 * cosine + 0.2 * (1 - 2 / 4))
    assert one[1].s.likeness == 1.0 and one[2].s.likeness == 0.3 * 1.0 * (one[2].s.trigrams == 1.0)


def plain_sentences(text):
    out, last, depth = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c in "།༎.!?" and depth <= 0 and not (c == "." and text[max(0, i - 10) : i].endswith(("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "etc", "e.g", "i.e"))):
            out.append(text[last : i + 1].strip())
            last = i + 1
    return [s for s in [*out, text[last:].strip()] if s]


def estimate(text):
    return math.ceil(len(re.findall("[ༀ-࿿]", text)) / 4) + math.ceil(len(re.sub("[ༀ-࿿]", " ", text).split()) * 1.3)


def plain_chunks(text, budget):
    if estimate(text) <= budget:
        return [text] if text.strip() else []
    out, now, tokens = [], [], 0
    for s in plain_sentences(text):
        n = estimate(s)
        if tokens + n > budget and now:
            out.append(" ".join(now))
            now, tokens = [], 0
        now.append(s)
        tokens += n
    return [*out, " ".join(now)] if now else out


@pytest.mark.parametrize("size", [3, 4096])
def test_sentences_and_chunks_over_page_ends(spark, monkeypatch, size):
    monkeypatch.setattr(S, "RANGE", size)
    rng = random.Random(9)
    rows, texts = [], {}
    for doc in [*range(12), None]:
        pages = []
        for page in range(rng.choice((1, 4, 25))):
            words = [rng.choice(("lama", "the", "came", "Dr.", "e.g.", "(see", "here)", "end.", "why?", "བླ་མ།", "x!", "stop.")) for _ in range(rng.randint(0, 12))]
            pages.append((page * rng.choice((1, 2)) + 100 * page, " ".join(words)))
        rows += [(doc, p, t or None) for p, t in pages]
        texts[doc] = " ".join(t for _, t in pages if t)
    df = spark.createDataFrame(rows, "doc_id long, page long, text string")
    got = defaultdict(list)
    for r in sorted(S.sentences(df).collect(), key=lambda r: r["pos"]):
        assert r["pos"] == len(got[r["doc_id"]])
        got[r["doc_id"]].append(r["sentence"])
    assert dict(got) == {d: s for d, t in texts.items() if (s := plain_sentences(t))}
    for budget in (1, 9, 30):
        made = defaultdict(list)
        for r in sorted(S.chunks(df, budget).collect(), key=lambda r: r["chunk"]):
            before = made[r["doc_id"]][-1] if made[r["doc_id"]] else ""
            assert r["chunk"] == len(made[r["doc_id"]]) and r["tokens"] == estimate(r["text"])
            assert r["overlap"] == before[len(before) - len(before) // 10 :]
            made[r["doc_id"]].append(r["text"])
        assert dict(made) == {d: c for d, t in texts.items() if (c := plain_chunks(t, budget))}
    assert S.chunks(df.limit(0)).count() == 0
    assert X.token_estimate is not None
