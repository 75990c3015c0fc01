"""Grades, calibration, alerts and chosen examples against plain versions that share no code with them."""

import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions import grading as G
from lodestone.operators import calibration as C
from lodestone.operators import examples as E
from lodestone.operators import monitors as M
from lodestone.operators import translations as T

SCRIPT = "[ༀ-࿿]"
TIB = ["བོད།", "ཆོས༎", "ལད་ཆེན།།", "ཀ"]


def tib(text):
    return len(re.findall(SCRIPT, text))


def plain_confidence(t, o, matched, terms):
    brackets = re.findall(rf"\([^)]*{SCRIPT}[^)]*\)", t)
    c = 0.5 + min(0.15, len(brackets) * 0.025)
    pieces = [s for s in re.split("[.!?]+", t) if s.strip()]
    if pieces:
        c += 0.15 * sum(1 for s in pieces if re.search(rf"\([^)]*{SCRIPT}[^)]*\)", s)) / len(pieces)
    if o:
        r = len(re.sub(r"\([^)]*\)", "", t)) / len(o)
        c += 0.1 if 0.5 <= r <= 3 else 0.05 if 0.3 <= r <= 4 else 0
    if not any(x in t for x in ("Error:", "Failed:", "I cannot", "I apologize")):
        c += 0.05
    c += 0.15 * (matched / terms if terms else 0.5)
    marks = lambda s: sum(s.count(m) for m in "།༎༑")
    had, kept = marks(o), marks(" ".join(brackets))
    c += 0.1 * (1.0 if had == 0 else max(0, min(kept / had, 1) - min(abs(had - kept) * 0.1, 0.3)))
    f = 1.0 - 0.3 * (t.count("(") != t.count(")"))
    f -= 0.2 * bool(re.match(r"(translation:|here is|i have translated|output:|result:)", t.strip(), re.I) or re.search("the translation is:", t, re.I))
    f -= 0.2 * (tib(re.sub(r"\([^)]*\)", "", t)) > 2)
    f -= 0.1 * (not re.search("[.!?]", t) and len(t) > 50)
    f -= 0.1 * (len(re.findall(r"\)\s*\(", t)) > 3)
    return min(0.98, max(0.1, c + 0.1 * max(0, f)))


def plain_aspects(t, o, used):
    clip = lambda x: max(0.0, min(1.0, x))
    quotes = re.search(rf"\([^)]*{SCRIPT}[^)]*\)", t)
    usage = clip(0.7 + min(0.3, used * 0.05) - (0 if quotes else 0.2))
    here, there = len(re.findall("[.!?]+", t)), len(re.findall("[.!?]+", o))
    s = 0.8 - (0.2 if max(here, there) and min(here, there) / max(here, there) < 0.8 else 0)
    s -= 0.15 if here and len(re.findall(r"[.!?]\s*\([^)]*\)", t)) / here < 0.7 else 0
    s += 0.1 if re.search(r"^\s*[*•-]", t, re.M) else 0
    listed = [x for x in G.TERMS if x in t.lower()]
    names = set(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", t, re.A)) | set(listed)
    forms = Counter(n.lower() for n in names)
    term = 0.8 - min(0.3, 0.1 * sum(1 for n in forms.values() if n > 1)) - (0.1 if listed else 0)
    a, b = len(re.sub(r"\s+", " ", re.sub(r"\([^)]*\)", "", t))), len(re.sub(r"\s+", " ", o))
    comp = 0.8 - (0.3 if a < 0.5 * b else 0.1 if a > 3 * b else 0)
    comp -= 0.2 if t.strip() and t.strip()[-1] not in ".!?" else 0
    comp -= 0.4 if re.search(SCRIPT + "{5,}", t) else 0
    nat = 0.7
    for p in (r"\b(the which|in which the|of the which)\b", r"\b(is being|are being)\b", r"\bthat that\b", r"\bof of\b"):
        nat -= 0.05 if re.search(p, t, re.I | re.A) else 0
    pieces = [x for x in re.split("[.!?]+", t) if x.strip()]
    if pieces:
        nat -= 0.1 if sum(len(re.split(r"\s+", x)) for x in pieces) / len(pieces) > 30 else 0
        nat -= 0.1 if max(Counter(x.split()[0].lower() for x in pieces).values()) > 3 else 0
    got = [usage, clip(s), clip(term), clip(comp), clip(nat)]
    return got, sum(x * w for x, w in zip(got, (0.2, 0.25, 0.2, 0.2, 0.15), strict=True))


def texts(rng, n):
    parts = ["The ", "the ", "Buddha ", "buddha ", "Dharma Wheel ", "karma", "\n* item ", ". ", "! ", "?? ", "(", ")", f"({TIB[0]}) ", f"({TIB[1]} x) ", TIB[2], TIB[3], " that that ", "of of", "is being ", "in which the ", "word ", "Error: ", "Here is ", "it ", "\n", "  ", "A", "Zed9 "]
    return ["".join(rng.choice(parts) for _ in range(rng.choice((0, 1, 3, 12, 60, 200)))) for _ in range(n)]


def test_grades_equal_plain_code(spark):
    rng = random.Random(5)
    t, o = texts(rng, 220), texts(rng, 220)
    t[:3], o[:3] = ["", "x", "word " * 300 + "."], ["", "", "one."]
    rows = [(i, o[i], t[i], rng.randrange(0, 4), rng.randrange(0, 9)) for i in range(len(t))]
    df = spark.createDataFrame(rows, "key long, o string, t string, terms long, used long")
    cover = F.least(F.col("used"), F.col("terms")) / F.when(F.col("terms") > 0, F.col("terms"))
    of = G.aspects(F.col("t"), F.col("o"), F.col("used"))
    got = {r["key"]: r for r in df.select("key", G.text_confidence(F.col("t"), F.col("o"), cover).alias("c"), *[c.alias(k) for k, c in of.items()], G.overall(of).alias("all")).collect()}
    for i, o_, t_, terms, used in rows:
        want, whole = plain_aspects(t_, o_, used)
        assert got[i]["c"] == pytest.approx(plain_confidence(t_, o_, min(used, terms), terms), abs=1e-9), t_
        assert [got[i][k] for k in G.WEIGHTS] == pytest.approx(want, abs=1e-9), t_
        assert got[i]["all"] == pytest.approx(whole, abs=1e-8)
    assert len({tuple(got[i][k] for k in G.WEIGHTS) for i in got}) > 40


def test_grades_of_nulls_long_runs_and_words(spark):
    long = "Aa " * 60000 + "."
    df = spark.createDataFrame([(None, None), ("a.", long), (long, "buddha.")], "o string, t string")
    of = G.aspects(F.col("t"), F.col("o"), F.lit(None).cast("long"))
    rows = df.select(G.text_confidence(F.col("t"), F.col("o")).alias("c"), G.consensus_confidence(F.col("t"), F.col("o"), F.lit(0.5)).alias("s"), *[c.alias(k) for k, c in of.items()], G.to_work_on(of | {"overall": G.overall(of)}).alias("w")).collect()
    assert all(r["c"] is not None and r["usage"] == pytest.approx(0.5) and r["s"] == pytest.approx(0.95) for r in rows)
    assert rows[0]["w"] == "usage" and rows[1]["naturalness"] == pytest.approx(0.6)
    assert [spark.range(1).select(G.grade(F.lit(x))).first()[0] for x in (0.9, 0.75, 0.6, 0.59)] == ["Excellent", "Good", "Fair", "Poor"]


def test_dictionary_hits_equal_plain_code(spark):
    rng = random.Random(2)
    words = ["ka", "kha", "gang", "lotus", "path", "pathway", "way", "sky", "skyline", "line"]
    dic = [(w, f"EN{w}", [f"alt{w}", f"other {w}"]) for w in words] + [("none", "x", None)]
    say = lambda k: " ".join(rng.choice([*words, *[f"en{w}" for w in words], *[f"Alt{w}" for w in words]]) for _ in range(k))
    pairs = [(i, say(rng.randrange(0, 9)), say(rng.randrange(0, 9))) for i in range(60)] + [(98, None, "x"), (99, "lotus", None)]
    got = {r["key"]: (r["terms"], r["matched"], r["used"]) for r in T.dictionary_hits(spark.createDataFrame(pairs, "key long, original string, translation string"), spark.createDataFrame(dic, "term string, english string, alternates array<string>"), 3).collect()}
    want = {}
    for k, o, t in pairs:
        held = sorted((d for d in dic if d[0] in (o or "")), key=lambda d: (-len(d[0]), d[0]))[:3]
        if held:
            low = (t or "").lower()
            want[k] = (len(held), sum(any(x.lower() in low for x in [e, *(a or [])]) for _, e, a in held), sum(e.lower() in low or w in (t or "") for w, e, _ in held))
    assert got == want and len(want) > 40


def test_calibration_equals_plain_code(spark):
    rng = random.Random(4)
    plain = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", s.lower().strip(), flags=re.A))
    names = ["Mar-pa ", "marpa", "MILA  Repa", "Mila Repa!", "é", "", "UNKNOWN"]
    cases = [(i, rng.choice("abc")) for i in range(80)]
    expected = [(i, rng.choice(("p", "t")), rng.choice(names)) for i, _ in cases for _ in range(rng.randrange(0, 4))]
    found = [(i, f"{i}-{j}", rng.choice(("p", "t")), [rng.choice(names[:6]) for _ in range(rng.randrange(0, 3))], rng.random()) for i, _ in cases for j in range(rng.randrange(0, 4))]
    ex = spark.createDataFrame(expected, "case_id long, type string, name string")
    scores = C.case_scores(spark.createDataFrame(cases, "case_id long, difficulty string"), ex, spark.createDataFrame(found, "case_id long, found_id string, type string, names array<string>, confidence double"))
    meets = lambda f, e: f[2] == e[1] and (e[2] == "UNKNOWN" or plain(e[2]) in [plain(n) for n in f[3]])
    want = {}
    for i, d in cases:
        e, f = [x for x in expected if x[0] == i], [x for x in found if x[0] == i]
        if not e and not f:
            want[i] = (d, 1, 1, 1, 1)
            continue
        met, sure = sum(any(meets(y, x) for y in f) for x in e), [y for y in f if y[4] > 0.8]
        p, r = (met / len(f) if f else 0), (met / len(e) if e else 0)
        right = sum(any(meets(y, x) for x in e) for y in sure) / len(sure) if sure else 1
        want[i] = (d, p, r, 2 * p * r / (p + r) if p + r else 0, right if f else 0)
    got = {r["case_id"]: (r["difficulty"], r["precision"], r["recall"], r["f1"], r["confidence_accuracy"]) for r in scores.collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and got[i][1:] == pytest.approx(want[i][1:]), i
    rows = {(r["scope"], r["value"]): r for r in C.calibration(scores, ex).collect()}
    kinds = [i for i in want if any(x[0] == i and x[1] == "p" for x in expected)]
    assert rows["type", "p"]["f1"] == pytest.approx(sum(want[i][3] for i in kinds) / len(kinds), abs=1e-6)
    hard = [i for i in want if want[i][0] == "a"]
    assert rows["difficulty", "a"]["passed"] == sum(want[i][3] >= 0.7 for i in hard) and rows["all", "all"]["cases"] == 80


def events(rng, n, periods):
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        p = rng.choice(periods)
        rows.append((p, t0 + timedelta(days=p, minutes=rng.randrange(0, 4), seconds=rng.choice((0, 0, 30))), i, round(rng.random(), 3), rng.choice((None, 0.4, 0.9)), rng.randrange(1, 100), float(rng.randrange(1, 50)), rng.choice((None, None, None, "E1", "E2", "E3"))))
    return rows


EVENTS = "period long, ts timestamp, id long, confidence double, quality double, ms long, api_ms double, error_type string"


@pytest.mark.parametrize("slice_seconds", [1, 60, 86400])
def test_halves_of_periods(spark, slice_seconds):
    rows = events(random.Random(1), 300, [1, 2, 3, 9]) + events(random.Random(2), 1, [20])
    got = {r["period"]: (r["first"], r["second"]) for r in M.half_means(spark.createDataFrame(rows, EVENTS), slice_seconds).collect()}
    for p in {r[0] for r in rows}:
        c = [r[3] for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[1], r[2]))]
        h = len(c) // 2
        assert got[p][1] == pytest.approx(sum(c[h:]) / (len(c) - h)) and (got[p][0] == pytest.approx(sum(c[:h]) / h) if h else got[p][0] is None)


def test_alerts_equal_plain_code(spark):
    x = {"confidence": 0.5, "quality": 0.65, "low_share": 0.6, "trend": 0.05, "drop": 0.05, "avg_ms": 50, "p95_ms": 94, "api_ms": 25, "per_minute": 4, "slower": 0.1, "error_warning": 0.4, "error_critical": 0.55, "recurring": 5, "kinds": 2, "spike": 1.3, "spike_least": 3}
    rows = [r for k, p in enumerate([1, 2, 3, 4, 6, 7, 8]) for r in events(random.Random(k), 12 + 3 * k, [p])]
    got = Counter((r["period"], r["category"], r["severity"], r["metric"], r["subject"], r["value"]) for r in M.alerts(spark.createDataFrame(rows, EVENTS), 5, **x).collect())
    by, want = defaultdict(list), Counter()
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by[r[0]].append(r)
    mean = lambda v: sum(v) / len(v) if v else 0
    fig = {p: {"c": mean([r[3] for r in v]), "q": mean([r[4] for r in v if r[4]]), "t": mean([r[5] for r in v]), "e": mean([r[7] is not None for r in v]), "k": Counter(r[7] for r in v if r[7])} for p, v in by.items()}
    for p, v in by.items():
        f, b = fig[p], fig.get(p - 1)
        say = lambda cat, sev, metric, value, subject=None: want.update([(p, cat, sev, metric, subject, round(value, 6))])  # noqa: B023, E731
        low, h = mean([r[3] < 0.6 for r in v]), len(v) // 2
        if f["c"] < x["confidence"]: say("quality", "critical", "confidence", f["c"])  # noqa: E701
        if 0 < f["q"] < x["quality"]: say("quality", "warning", "quality", f["q"])  # noqa: E701
        if low > x["low_share"]: say("quality", "warning", "low_share", low)  # noqa: E701
        if mean([r[3] for r in v[h:]]) - mean([r[3] for r in v[:h]]) < -x["trend"]: say("quality", "warning", "trend", f["c"])  # noqa: E701
        if f["t"] > x["avg_ms"]: say("performance", "warning", "avg_ms", f["t"])  # noqa: E701
        p95 = sorted(r[5] for r in v)[math.ceil(0.95 * len(v)) - 1]
        if p95 > x["p95_ms"]: say("performance", "critical", "p95_ms", p95)  # noqa: E701
        api = mean([r[6] for r in v])
        if api > x["api_ms"]: say("performance", "warning", "api_ms", api)  # noqa: E701
        if len(v) / 5 < x["per_minute"]: say("performance", "warning", "per_minute", len(v) / 5)  # noqa: E701
        if f["e"] >= x["error_critical"]: say("error", "critical", "error_rate", f["e"])  # noqa: E701
        elif f["e"] >= x["error_warning"]: say("error", "warning", "error_rate", f["e"])  # noqa: E701
        for kind, n in sorted(f["k"].items(), key=lambda kn: (-kn[1], kn[0]))[:2]:
            if n >= 5: say("error", "warning", "count", n, kind)  # noqa: E701
        if b:
            if b["c"] - f["c"] > x["drop"]: say("quality", "critical", "drop", f["c"])  # noqa: E701
            if b["q"] > 0 and f["q"] > 0 and b["q"] - f["q"] > x["drop"]: say("quality", "warning", "quality_drop", f["q"])  # noqa: E701
            if f["t"] - b["t"] > x["slower"] * b["t"]: say("performance", "critical", "slower", f["t"])  # noqa: E701
            if b["e"] > 0 and f["e"] >= x["spike"] * b["e"]: say("error", "critical", "spike", f["e"])  # noqa: E701
            for kind, n in f["k"].items():
                if b["k"][kind] and n >= x["spike"] * b["k"][kind] and n >= 3: say("error", "warning", "count", n, kind)  # noqa: E701
    assert got == want and len({k[3] for k in want}) >= 13
    counts = {r["period"]: r["total"] for r in M.alert_counts(M.alerts(spark.createDataFrame(rows, EVENTS), 5, **x)).collect()}
    assert sum(counts.values()) == sum(want.values())
    with pytest.raises(ValueError):
        M.alerts(spark.createDataFrame(rows, EVENTS), 5, speed=3)


def plain_examples(inputs, library, count, category, diverse, at_least, prefer):
    pool = [e for e in library if e[1] == category] if category else library
    pool = sorted(pool or library)
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)
    cos = lambda a, b: (lambda n: round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0)(math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)))
    out = set()
    for q, v, words in inputs:
        words = words or []
        scored, way = [(cos(v, e[2]), e) for e in pool if ok(v) and ok(e[2])], "vectors"
        scored = [s for s in scored if s[0] >= at_least]
        if not scored:
            scored, way = [(round(sum(w in (e[3] or []) for w in words) / max(len(words), 1), 9), e) for e in pool], "keywords"
        scored = sorted(((round(s * 1.2, 9) if prefer and e[1] == prefer else s, e) for s, e in scored), key=lambda s: -s[0])
        chosen, half = [], -(-count // 2)
        for _, e in scored:
            if len(chosen) < count and (not diverse or sum(c[1] == e[1] for c in chosen) < half):
                chosen.append(e)
        for _, e in scored:
            if len(chosen) < count and e not in chosen:
                chosen.append(e)
        if way == "keywords" and (not scored or scored[0][0] == 0):
            way, chosen, kinds = "default", [], list(dict.fromkeys(e[1] for e in pool))
            for i in range(count if kinds else 0):
                chosen += [e for e in pool if e[1] == kinds[i % len(kinds)] and e not in chosen][:1]
        out |= {(q, way, i + 1, e[0]) for i, e in enumerate(chosen)}
    return out


@pytest.mark.parametrize(("count", "category", "diverse", "prefer"), [(3, None, True, None), (4, None, True, "b"), (5, "a", True, None), (3, "none", False, "a"), (1, None, True, None), (9, None, True, None)])
def test_examples_equal_plain_code(spark, count, category, diverse, prefer):
    rng = random.Random(count)
    vec = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]
    words = lambda n: [rng.choice("uvwxyz") for _ in range(n)]
    library = [(i, rng.choice("aabcd"), rng.choice((None, vec(), vec(), [None, 1.0, 2.0, 0.0])), rng.choice((None, words(1), words(2)))) for i in range(1, 31)]
    inputs = [(i, rng.choice((None, [0.0] * 4, vec(), [9.0, -9.0, 9.0, -8.0])), rng.choice((None, [], ["q"], words(3), words(5)))) for i in range(40)]
    got = E.select_examples(
        spark.createDataFrame(inputs, "query_id long, embedding array<double>, keywords array<string>"), spark.createDataFrame(library, "example_id long, category string, embedding array<double>, keywords array<string>"), count, category, diverse, 0.8, prefer
    ).collect()
    want = plain_examples(inputs, library, count, category, diverse, 0.8, prefer)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {w for _, w, _, _ in want} == {"vectors", "keywords", "default"}


def test_examples_of_nothing(spark):
    inputs = spark.createDataFrame([(1, [1.0], ["a"])], "query_id long, embedding array<double>, keywords array<string>")
    library = spark.createDataFrame([], "example_id long, category string, embedding array<double>, keywords array<string>")
    assert E.select_examples(inputs, library).collect() == [] and E.select_examples(inputs.limit(0), library).collect() == []
