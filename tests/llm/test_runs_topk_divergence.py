"""Periodic runs, exact top k and source divergence, against plain versions that share no code with them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import divergence, periodic, topk
from lodestone.llm.common import table
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string"


def plain_runs(w):
    """Runs (start, length, period) by trying all periods; the smallest period of each stretch decides."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = w[i : i + length]
                if not any(all(part[t] == part[t + r] for t in range(length - r)) for r in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words_equal_trying_all_periods():
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        w = []
        while len(w) < rng.randint(1, 90):
            w += [rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(rng.randint(1, 7))] * rng.randint(1, 9)
        texts.append(np.array(w))
    points = [periodic.grid_candidates(t) for t in texts]
    for t, found in zip(texts, periodic.runs_of(texts, points), strict=True):
        assert [tuple(r) for r in found.tolist()] == plain_runs(t.tolist())


def test_grid_of_long_texts_comes_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    t = np.concatenate([rng.integers(0, 500, 900), np.tile(rng.integers(0, 500, 211), 6), rng.integers(0, 500, 300), np.zeros(400, np.int64)])
    whole = periodic.runs_of([t], [periodic.grid_candidates(t)])[0].tolist()
    monkeypatch.setattr(periodic, "TABLE_WORDS", 10)
    monkeypatch.setattr(periodic, "GRID_PART", 500)
    assert periodic.runs_of([t], [periodic.grid_candidates(t)])[0].tolist() == whole == [list(r) for r in plain_runs(t.tolist())]


def test_run_report_equals_the_plain_version_on_documents_and_odd_rows(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    odd = [(None, "a b " * 9), (None, None), (7, None), (8, ""), (9, " \t\n"), (10, "x " * 7 + "  y"), (10, "x " * 7 + "  y"), (11, "A a A a A a A a A"), (30, "é b " * 5), (57, "w"), (58, "w " * 4000 + "v " * 3000)]
    rows = docs.limit(0).union(docs).union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = [tuple(r) for r in periodic.run_report(periodic.looped(rows)).collect()]
    small = [(r["doc_id"], r["text"]) for r in rows.collect() if len(r["text"] or "") < 8000]
    want = {}
    for d, t in small:
        want.setdefault((d, *plain_report(d, t)[1:]), 0)
        want[d, *plain_report(d, t)[1:]] += 1
    have = Counter(got)
    assert sum(have.values()) == rows.count()
    assert all(have[k] == n for k, n in want.items())
    assert [r[1:6] for r in got if r[0] == 58 and r[1]] and sum(1 for r in got if r[1]) > 5


def test_periodic_runs_keep_other_columns_and_replace_clashing_ones(spark):
    docs = spark.createDataFrame([(1, "q r " * 5, "x", 4)], "doc_id long, text string, _runs string, _h int")
    got = periodic.periodic_runs(docs).first()
    assert got["_h"] == 4 and [tuple(r) for r in got["_runs"]] == [(0, 10, 2)] and got["_collapsed"] == "q r"
    assert periodic.run_report(periodic.looped(docs)).count() == 1
    assert periodic.run_report(docs.limit(0)).collect() == []


def plain_top(rows, k, every):
    v = {i: [math.floor(64 * float(x)) for x in e] for i, e in rows if i is not None and e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in (i for i in v if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("pivots", [1, 4, 64])
def test_top_k_equals_all_products_with_ties_copies_and_odd_vectors(spark, pivots, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "SET_QUERIES", 9)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 5)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * 0.05).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, [0.5, 0.25, -0.5, 0.0, 1.0]) for i in range(700, 1100)]  # a third of all rows are the same
    rows += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 5), (2060, [float("inf")] * 5), (None, [1.0] * 5), (2080, []), (2100, [1.0, 2.0]), (2101, [1.0, -2.0]), (2120, [0.0] * 5)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], VECTORS)
    got = sorted(tuple(r) for r in topk.top_products(df, 7, 20, pivots=pivots).collect())
    assert got == plain_top(rows, 7, 20)


def test_top_k_of_large_numbers_repeated_ids_few_rows_and_none(spark):
    rows = [(0, [3.0e12, 1.0]), (1, [-3.0e12, 2.0]), (2, [2.0, 5.0e9])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS v", "3 AS query")
    with pytest.raises(Exception, match="no long"):  # 3e12 * 64 squared
        topk.top_products(df).collect()
    rows = [(0, [3.0e7, 1.0]), (20, [-3.0e7, 2.0]), (2, [2.0, 5.0e7])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows] * 2, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS v")
    assert sorted(tuple(r) for r in topk.top_products(df).collect()) == plain_top(rows, 20, 20)
    assert topk.top_products(df.limit(0)).collect() == []
    assert topk.top_products(df.where("vec_id = 0").distinct()).collect() == []


def test_bounds_leave_out_what_cannot_matter():
    between = np.array([[0.0, 10.0], [10.0, 0.0]])
    count = np.zeros((2, 4), np.int64)
    count[0, 0], count[1, 0] = 5, 5
    assert topk.group_bounds(between, np.array([1.0, 1.0]), count, 1.0, 5).tolist() == [2.0, 2.0]
    assert topk.group_bounds(between, np.array([1.0, 1.0]), count, 1.0, 6).tolist() == [12.0, 12.0]
    assert topk.group_bounds(between, np.array([1.0, 1.0]), count, 1.0, 11).tolist() == [np.inf, np.inf]


def plain_divergence(rows):
    docs = [(lang or "", source or "", [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    has, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        has[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = {t for t, c in has[lang].items() if c >= 10}
        groups = {s: {t: c for t, c in n[x, s].items() if t in kept} for x, s in n if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)
        share = lambda c: {t: 1 + 10**9 * (c.get(t, 0) + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s].get(t, 0) and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_equals_the_plain_version_on_documents_and_odd_rows(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source")
    odd = [(None, None, None, None), (None, "Zyx ÀB c-d\x7fe", None, "s"), (5, "", "en", "none"), (5, "only here", "xx", "s"), (5, "only here", "xx", None), *[(6, f"Hot hot É {'tie' * (i % 3)}", "yy", f"s{i % 4}") for i in range(60)], *[(6, "rare", "yy", "s9")] * 9]
    rows = docs.union(spark.createDataFrame(odd, DOCS))
    got = sorted(tuple(r) for r in divergence.source_divergence(rows.selectExpr("*", "1 AS vector", "2 AS m", "3 AS docs")).collect())
    assert got == plain_divergence([tuple(r) for r in rows.collect()])
    assert {r[2] for r in got} == {"pair", "term"}


def test_divergence_hands_counts_on_and_takes_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    rows = [(i, f"a b{i % 2} c", "l", f"s{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in divergence.source_divergence(df).collect()) == plain_divergence(rows)
    assert divergence.source_divergence(df.limit(0)).collect() == []
    assert divergence.term_counts(df).agg(F.sum("n")).first()[0] == 120
