"""Page layout against plain versions, and methods over the tables against plain versions on whole small tables."""

import hashlib
import math
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.functions import text as X
from lodestone.operators import alignment as A
from lodestone.operators import layout as L
from lodestone.plans.method_queries import answers
from lodestone.session import table
from lodestone.sources.views import laid_out
from tests.conftest import SF
from tests.test_methods import plain_chunks, plain_sentences

ITEM = "doc_id long, page long, n long, text string, x double, y double, width double, height double"


def plain_layout(items):
    """Columns of one page as (method, columns, confidence)."""
    xs = sorted(i["x"] for i in items)

    def strips(k):
        out = [[] for _ in range(k)]
        for x in xs:
            out[min(int((x - xs[0]) // ((xs[-1] - xs[0]) / k)), k - 1)].append(x)
        return [s for s in out if s]

    clusters = [xs]
    for k in (2, 3) if xs[0] < xs[-1] else ():
        new = strips(k)
        centres = [sum(c) / len(c) for c in new]
        if any(b - a < 40 for a, b in zip(centres, centres[1:])):
            break
        clusters = new

    def found(groups):
        return [g for g in groups if len(g[2]) >= 5]

    if len(clusters) == 1:
        first = ("strips", [(xs[0], xs[-1], items)], 0.9)
    else:
        near = [[i for i in items if abs(i["x"] - (c[0] + c[-1]) / 2) <= (c[-1] - c[0]) / 2 + 20] for c in clusters]
        cols = found([(min(i["x"] for i in g), max(i["x"] + i["width"] for i in g), g) for g in near])
        n = [len(c[2]) for c in cols]
        sure = 0 if not n else 0.9
        if len(n) > 1:
            mean = sum(n) / len(n)
            sure = 0.4 * (1 - min(sum((x - mean) ** 2 for x in n) / len(n) / mean**2, 1)) + 0.6 * min(min(b[0] - a[1] for a, b in zip(cols, cols[1:])) / 40, 1)
        first = ("strips", cols, sure)
    order = sorted(items, key=lambda i: (i["x"], i["n"]))
    gaps = [(b["x"] - a["x"] - a["width"], a["x"] + a["width"] + (b["x"] - a["x"] - a["width"]) / 2) for a, b in zip(order, order[1:]) if b["x"] - a["x"] - a["width"] >= 40]
    end = max(i["x"] + i["width"] for i in items)
    if not gaps:
        second = ("gaps", [(xs[0], end, items)], 0.85)
    else:
        cuts = [xs[0], *sorted(at for _, at in sorted(gaps, key=lambda g: (-g[0], g[1]))[:2]), end]
        cols = found([(a, b, [i for i in items if i["x"] >= a and i["x"] + i["width"] <= b]) for a, b in zip(cuts, cuts[1:])])
        n = [len(c[2]) for c in cols]
        sure = 0 if not n else 0.85
        if len(n) > 1:
            sure = 0.5 * min(sum(g for g, _ in gaps) / len(gaps) / 80, 1) + 0.5 * (1 - min(max(n) / (sum(n) / len(n)) - 1, 0.5) / 0.5)
        second = ("gaps", cols, sure)
    method, cols, sure = first if first[2] > second[2] else second
    for left, right, own in cols:
        sure *= (0.8 if right - left < 100 else 1) * (0.7 if len(own) < 5 else 1)
    return (method, 1, 0.8) if sure < 0.5 and len(cols) > 1 else (method, len(cols), sure)


def test_columns_of_pages_equal_the_plain_version(spark):
    import random

    rng = random.Random(4)
    rows = []
    for page in range(60):
        starts = rng.choice(([50], [50, 350], [50, 230, 420], [50, 90]))
        for n in range(rng.choice((1, 3, 7, 40))):
            rows.append((1, page, n, "w", float(rng.choice(starts) + rng.choice((0, 1, 40, 80)) * rng.random()), float(700 - n * 12), rng.choice((5.0, 30.0)), 10.0))
    got = {r["page"]: r for r in L.column_layout(spark.createDataFrame(rows, ITEM)).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(dict(zip(("doc_id", "page", "n", "text", "x", "y", "width", "height"), r, strict=True)))
    for page, items in by.items():
        method, columns, sure = plain_layout(items)
        assert (got[page]["columns"], got[page]["confidence"]) == (columns, pytest.approx(sure, abs=1e-5)), page
    real = L.column_layout(laid_out(spark, SF)).groupBy((F.col("doc_id") % 3 == 0).alias("two"), "columns").count().collect()
    assert {r["columns"] for r in real if r["two"]} >= {2}
    empty = spark.createDataFrame([], ITEM)
    assert L.column_layout(empty).count() == 0 == L.lines(empty).count()


def test_lines_and_spaces(spark):
    rows = [(1, 0, 0, "left", 10.0, 700.0, 20.0, 10.0), (1, 0, 1, "right", 90.0, 699.0, 20.0, 10.0), (1, 0, 2, "near", 34.0, 701.0, 20.0, 10.0), (1, 0, 3, "touch", 54.5, 700.0, 20.0, 10.0), (1, 0, 4, "below", 10.0, 688.0, 20.0, 10.0), (1, 0, 5, "far below", 10.0, 660.0, 20.0, 10.0), (1, 0, 6, "བླ་", 10.0, 640.0, 5.0, 10.0), (1, 0, 7, "མ", 25.0, 640.0, 5.0, 10.0), (1, 0, 8, None, 0.0, 0.0, 0.0, 0.0)]
    got = [(r["line"], r["text"], r["paragraph"]) for r in L.lines(spark.createDataFrame(rows, ITEM)).orderBy("line").collect()]
    assert got == [(1, "left neartouch right", False), (2, "below", False), (3, "far below", True), (4, "བླ་མ", True)]


def test_normal_form(spark):
    texts = ["plain", "é", "ét́ é", None, "한글", "한", "ạ̇", "ạ̇", "q́"]
    for t, r in zip(texts, spark.createDataFrame([(t,) for t in texts], "t string").select(X.normal_form(F.col("t")).alias("f")).collect(), strict=True):
        assert r.f.text == unicodedata.normalize("NFC", t or "") and r.f.composed == (r.f.text == (t or ""))
        assert r.f.mixed == (t == "ét́ é")


def _sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_sentences_and_chunks_of_all_documents(spark):
    q = registry.queries()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    got = {(r["doc_id"], r["pos"], r["sha"]) for r in q["sf3_sentences"](spark, SF).collect()}
    joined = {d: " ".join(x for x in t.split("\n") if x) for d, t in texts.items()}
    assert got == {(d, i, _sha(s)) for d, t in joined.items() for i, s in enumerate(plain_sentences(t))}
    latin = "[À-ÿ]"
    import tests.test_methods as plain

    before, plain.estimate = plain.estimate, lambda t: math.ceil(len(re.findall(latin, t)) / 4) + math.ceil(len(re.sub(latin, " ", t).split()) * 1.3)
    try:
        for name, of in (("sf4_chunks", texts), ("sf5_chunks_over_pages", joined)):
            want = {(d, i, _sha(c)) for d, t in of.items() for i, c in enumerate(plain_chunks(t, 200))}
            assert {(r["doc_id"], r["chunk"], r["sha"]) for r in q[name](spark, SF).collect()} == want, name
    finally:
        plain.estimate = before


@pytest.mark.parametrize("method", ["global", "place"])
def test_consensus_of_all_conversations(spark, method):
    base, helpers = (df.collect() for df in answers(spark, SF))
    by = defaultdict(list)
    for h in helpers:
        by[h["key"]].append(h)
    want = {}
    for b in base:
        sound = sorted((h for h in by[b["key"]] if h["confidence"] >= 0.3 and (h["text"] or "").strip()), key=lambda h: h["helper"])
        if not sound:
            want[b["key"]] = (b["text"].strip(), 1.0, b["confidence"] * (0.9 if by[b["key"]] else 1))
            continue
        mine, said, agree = A.sentences(b["text"]), [], []
        likes = []
        for h in sound:
            theirs = A.sentences(h["text"])
            like = A.likeness(mine, theirs)
            at = A.aligned(like) if method == "global" else A.by_place(like, mine, theirs)
            likes.append([(like[i, j], theirs[j]) if j >= 0 else None for i, j in enumerate(at)])
        for i, s in enumerate(mine):
            met = [(x[i][0], h["confidence"], x[i][1]) for x, h in zip(likes, sound, strict=True) if x[i]]
            top = max(met, key=lambda m: m[0], default=None)  # the first of equals
            taken = top and top[0] > 0.8 and top[1] > 0.8
            said.append(top[2] if taken else s)
            agree.append(1.0 if not top else top[0] * (0.8 if not taken and top[0] >= 0.7 else 1))
        a = sum(agree) / len(agree)
        mean = sum(h["confidence"] for h in sound) / len(sound)
        want[b["key"]] = (" ".join(said).strip(), a, min(0.98, max(0.1, 0.4 * b["confidence"] + 0.6 * mean + 0.2 * a - (0.1 if a < 0.5 else 0))))
    got = A.consensus(*answers(spark, SF), method).collect()
    assert {r["key"]: r["text"] for r in got} == {k: v[0] for k, v in want.items()}
    for r in got:
        assert (r["agreement"], r["confidence"]) == (pytest.approx(want[r["key"]][1], abs=2e-6), pytest.approx(want[r["key"]][2], abs=2e-6))
