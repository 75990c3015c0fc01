"""Artifacts of pages, kinds of errors, names, journeys and named cycles against plain versions and known cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates as D
from lodestone.functions import errors as X
from lodestone.operators import artifacts as A
from lodestone.operators import graph as G

WHITE = " \t\n\x0b\f\r"


def plain_patterns(text):
    lines = text.split("\n")
    out = {}
    for line, n in Counter(x.strip(WHITE) for x in lines).items():
        if not line or len(line) > 100 or n < 3:
            continue
        kind = "page-number" if re.fullmatch(r"\d+|page \d+|\d+ of \d+", line, re.I | re.A) else "footer" if re.search("copyright|©|all rights reserved", line, re.I) else "watermark" if re.search("draft|confidential|proprietary", line, re.I) else "header" if len(line) < 50 else "unknown"
        sure = min(n / len(lines) * 10, 0.5) + 0.2 * (len(line) < 30) + 0.3 * bool(re.search("page|copyright|draft|header|footer", line, re.I))
        sure += 0.4 * bool(re.fullmatch("[0-9]+", line)) + 0.4 * bool(re.search("draft|confidential|proprietary", line, re.I)) + 0.4 * bool(re.search("copyright|©|[0-9]+ of [0-9]+", line, re.I))
        out[line] = (n, kind, round(min(sure, 1.0), 9))
    return out


def plain_clean(text):
    """One pattern after the other is taken out of the whole text, then page numbers, then blanks."""
    for line, (_, _, sure) in plain_patterns(text).items():
        if sure > 0.7:
            text = re.sub(rf"^[{WHITE}]*{re.escape(line)}[{WHITE}]*$", "", text, flags=re.M | re.I)
    for p in (r"\d+", rf"page[{WHITE}]+\d+", rf"\d+[{WHITE}]+of[{WHITE}]+\d+"):
        text = re.sub(rf"^[{WHITE}]*(?:{p})[{WHITE}]*$", "", text, flags=re.M | re.I | re.A)
    text = re.sub(r"\n{3,}", "\n\n", text)
    return "\n".join(x.rstrip(WHITE) for x in text.split("\n")).strip(WHITE)


def test_artifacts_equal_plain_code(spark):
    rng = random.Random(3)
    lines = ["Copyright 2001", "copyright 2001 ", "  Page 3", "DRAFT", "draft", "17", "page  4", "3 of 9", "3  of  9", "chapter one", "chapter header", "", "", "   ", "\t", "body text that goes on", "a longer line that repeats and is over thirty characters", "(c) [x] $1 ^ page", "x" * 120]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.choice((1, 2, 5, 12, 40)))) for _ in range(250)] + ["", "\n\n\n", "  \n x \n ", "a\n\nDRAFT\n \nb\nDRAFT\nDRAFT\nc"]
    df = spark.createDataFrame([*enumerate(texts), (9999, None)], "doc_id long, text string")
    found = {}
    for r in A.line_artifacts(df).collect():
        found.setdefault(r["doc_id"], {})[r["line"]] = (r["n"], r["kind"], r["confidence"])
    got = {r["doc_id"]: r["text"] for r in A.without_artifacts(df).collect()}
    for i, t in enumerate(texts):
        assert found.get(i, {}) == plain_patterns(t), repr(t)
        assert got[i] == plain_clean(t), repr(t)
    assert got[9999] == "" and 9999 not in found
    assert sum(plain_clean(t) != t for t in texts) > 150


def test_artifacts_of_long_texts_and_none(spark):
    long = "Copyright 7\n" + "word " * 400000 + "\n\n\n" * 2000 + "Copyright 7\nCopyright 7\n" + "end"
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    r = A.without_artifacts(df).first()
    assert r["dropped"] == 3 and r["text"] == "word " * 399999 + "word\n\nend"
    assert A.without_artifacts(df.limit(0)).collect() == [] and A.line_artifacts(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("message", "code", "status", "kind", "action"),
    [
        ("Rate limit: request aborted", None, 429, "CANCELLATION", "FAIL"), ("", "", 429, "RATE_LIMIT", "RETRY"), ("bad API key", None, None, "INVALID_API_KEY", "FAIL"), ("x", "econnreset", 503, "NETWORK_ERROR", "RETRY"),
        ("x", "MY_NETWORK_1", None, "NETWORK_ERROR", "RETRY"), ("request timed out", None, 503, "TIMEOUT", "RETRY"), ("overload", None, 503, "API_UNAVAILABLE", "RETRY"), ("overload", None, None, "SERVICE_OVERLOADED", "RETRY"),
        ("x", "validation_error", None, "INVALID_INPUT", "FIX_INPUT"), ("cannot parse", None, None, "INVALID_FORMAT", "FIX_INPUT"), ("Empty", None, None, "EMPTY_TEXT", "FAIL"), ("x", "TRANSLATION_ERROR", None, "TRANSLATION_FAILED", "FALLBACK"),
        ("low quality", None, None, "QUALITY_TOO_LOW", "FALLBACK"), ("blocked", None, None, "CONTENT_POLICY_VIOLATION", "FALLBACK"), ("x", "DB_1", None, "DATABASE_ERROR", "RETRY"), ("unsupported file", None, None, "UNSUPPORTED_FILE", "FAIL"),
        ("bad config", None, None, "CONFIGURATION_ERROR", "FAIL"), (None, None, None, "UNKNOWN", "RETRY"), ("x", "EXIT", 200, "UNKNOWN", "RETRY"),
    ],
)
def test_error_kinds(spark, message, code, status, kind, action):
    df = spark.createDataFrame([(message, code, status)], "m string, c string, s int").select(X.error_kind(F.col("m"), F.col("c"), F.col("s")).alias("k")).select("k", X.recovery(F.col("k")).alias("r"))
    r = df.first()
    assert (r["k"], r["r"]["action"]) == (kind, action) and r["r"]["retryable"] == (r["r"]["retries"] > 0)


def test_names_are_searched_in_order(spark):
    rows = [("1", "person", "Milarepa", "active", ["The Poet"], None, None), ("2", "person", "Jetsun", "active", ["milarepa"], ["Mi la"], None), ("3", "text", "Songs of Milarepa", "active", None, None, None), ("4", "person", "X", "active", ["Songs of Milarepa, the book"], None, None), ("5", "person", None, "active", None, [None, "o Milarepa"], None), ("6", "person", "Y", "active", None, None, ["milarepa"]), ("7", "person", "Milarepa", "merged", None, None, None)]
    df = spark.createDataFrame(rows, "id string, type string, name string, merge_status string, english array<string>, tibetan array<string>, phonetic array<string>")
    got = [(r["id"], r["score"], r["field"]) for r in G.search_names(df, "MILArepa").collect()]
    assert got == [("1", 1.0, "name"), ("2", 0.9, "english"), ("3", 0.8, "other"), ("4", 0.7, "english"), ("5", 0.5, "tibetan"), ("6", 0.5, "other")]
    assert [r["id"] for r in G.search_names(df, "milarepa", fuzzy=False).collect()] == ["2", "6"]
    assert [r["id"] for r in G.search_names(df, "milarepa", types=["text"]).collect()] == ["3"] and G.search_names(df.limit(0), "x").collect() == []


def test_journeys_go_by_year(spark):
    nodes = spark.createDataFrame([("p", "person", "P"), ("a", "place", "A"), ("b", "place", "B"), ("t", "text", "T")], "id string, type string, name string")
    edges = spark.createDataFrame(
        [("p", "visited", "b", 0.9, 1200, None, None, "study"), ("p", "lived_at", "a", None, None, None, None, None), ("p", "taught_at", "a", 0.4, 1300, 1100, 1110, None), ("p", "wrote", "a", 1.0, 1, 1, 1, None), ("p", "visited", "t", 1.0, 1, 1, 1, None), ("a", "visited", "b", 1.0, 1, 1, 1, None)],
        "src string, predicate string, dst string, confidence double, year long, start_year long, end_year long, purpose string",
    )
    got = [tuple(r) for r in G.journeys(nodes, edges).orderBy("person", "stop").collect()]
    assert got == [("p", 1, "a", "A", 1100, 1110, "taught_at", 0.4), ("p", 2, "b", "B", 1200, None, "study", 0.9), ("p", 3, "a", "A", None, None, "lived_at", 0.5)]
    assert G.journeys(nodes, edges.select("src", "predicate", "dst", "confidence")).count() == 3


def test_named_cycles(spark):
    cases = {"the fire rabbit year of the 1st Rabjung": (1027, 0.9), "earth dragon, 3rd rabjung": None, "17th rabjung": (1987 + 29, 0.5), "in the 18th rabjung": None, "rabjung 5": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", D.named_cycle_year(F.col("t")).alias("r"))
    got = {r["t"]: r["r"] and tuple(r["r"]) for r in df.collect()}
    first = next(i for i in range(60) if D.ELEMENTS[i // 4 % 5] == "earth" and D.ANIMALS[i % 12] == "dragon") if any(D.ELEMENTS[i // 4 % 5] == "earth" and D.ANIMALS[i % 12] == "dragon" for i in range(60)) else None
    cases["earth dragon, 3rd rabjung"] = (1147 + first, 0.9) if first is not None else (1147 + 29, 0.5)
    assert got == {**cases, None: None}


def test_source_is_chosen(spark):
    from lodestone.functions.checks import chosen_source

    long, bo = "own text " * 40, "བོད " * 60
    rows = [(1, long, bo, 2, 0.9), (2, "x", bo, 0, 0.9), (3, "x", None, 4, 0.9), (4, "x", bo, 4, 0.9), (5, None, "bad", 4, 0.1), (6, long, "bad " * 40, 40, 0.1), (7, "short", "bad " * 40, 40, None), (8, long, "bad", 40, 0.1), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, "i long, own string, read string, pages long, sure double").select("i", chosen_source(F.col("own"), F.col("read"), F.col("pages"), F.col("sure")).alias("c"))
    got = {r["i"]: (r["c"]["method"], r["c"]["text"]) for r in df.collect()}
    both = long + "\n\n[OCR-Enhanced Content]\n\n" + "bad " * 40
    assert got == {1: ("native", long), 2: ("native", "x"), 3: ("native", "x"), 4: ("ocr", bo), 5: ("ocr", "bad"), 6: ("hybrid", both), 7: ("hybrid", "bad " * 40), 8: ("hybrid", long), 9: ("native", "")}


def test_weeks_with_reviews_or_corrections(spark):
    from lodestone.operators.stats import weekly_report

    reviews = spark.createDataFrame([("2024-01-02", "2024-01-03", "approved"), ("2024-01-04", None, "pending")], "c string, r string, status string").select(F.to_timestamp("c").alias("created"), F.to_timestamp("r").alias("reviewed"), "status")
    fixes = spark.createDataFrame([("2024-01-02", "term"), ("2024-01-02", "term"), ("2024-01-03", "style"), ("2024-01-09", None)], "c string, kind string").select(F.to_timestamp("c").alias("created"), "kind")
    got = {r["week"]: (r["n"], r["reviewed"], r["turnaround"], r["approval"], r["corrections"], r["by_kind"]) for r in weekly_report(reviews, fixes).collect()}
    assert got == {"2024-W01": (2, 1, 1440.0, 1.0, 3, "style:1,term:2"), "2024-W02": (0, 0, None, 0.0, 1, "none:1")}
