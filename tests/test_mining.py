"""Relations, signals, records and checks on a few rows that can be read."""

import random
import re

from pyspark.sql import functions as F

from lodestone.functions import checks as C
from lodestone.functions import names as N
from lodestone.operators import mining as M
from lodestone.operators import records as R
from lodestone.operators import signals as S


def test_relations_with_places_titles_and_inverses(spark):
    docs = spark.createDataFrame([(1, "Marpa Lotsawa was taught by Naropa. Later, Milarepaa studied under Marpa."), (2, "Nobody Known taught Marpa."), (3, None), (4, "")], "doc_id long, text string")
    people = spark.createDataFrame([("m", "Marpa", 0.9), ("n", "Naropa", 0.5), ("l", "Milarepa", 0.8), ("m2", "marpa", 0.2)], "id string, name string, confidence double")
    found = M.matches(docs)
    assert [(r.predicate, r.subject, r.object, r.position) for r in found.where("doc_id = 1").collect()] == [("teacher_of", "Naropa", "Marpa Lotsawa", 1), ("student_of", "Milarepaa", "Marpa", 44)]
    got = {(r.src, r.predicate, r.dst, r.confidence, r.inverse, r.needs_review) for r in M.edges(found, people).collect()}
    assert got == {("n", "teacher_of", "m", 0.595, False, True), ("m", "student_of", "n", 0.595, True, True), ("l", "student_of", "m", 0.765, False, False), ("m", "teacher_of", "l", 0.765, True, False)}
    own = (*M.chosen(categories=["places"]), M.Rule("praised", rf"{M.NAME} praised {M.NAME}", 0.5))
    assert [r.predicate for r in M.matches(spark.createDataFrame([(1, "Marpa praised Naropa. Naropa taught Marpa.")], "doc_id long, text string"), own).collect()] == ["praised"]


def test_a_text_is_matched_by_every_rule_at_its_true_places(spark):
    rng = random.Random(1)
    plain = lambda p: re.sub(r"\(\?P<(?:subject|object|place)>.*?\]\+\)\*\)", "NAME", re.sub(r"\(\?P<teaching>.*?\*\?\)", "Great Seal", p.replace(r"(?P<duration>\d+ years?)", "3 years").replace(r"(?P<date>\d{3,4})", "1042")))

    def one(p):  # a text that the rule may match: the first way of each choice, by chance without what can be left out
        p = re.sub(r"\(\?=\[.*", ".", plain(p)).replace(r"(?P<object>\d+)", "3")
        while "(?:" in p:
            p = re.sub(r"\(\?:([^()]*)\)(\?)?", lambda m: "" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|")), p)
        p = re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", p)
        return re.sub("NAME", lambda _: rng.choice(("Marpa", "Milarepa", "Drogmi Lotsawa", "Samye")), p)

    texts = [" ".join(one(r.pattern) + rng.choice((". ", ", ", " ")) for r in rng.sample(M.RULES, 6) for _ in range(2)) for _ in range(150)] + [one(r.pattern) + "." for r in M.RULES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {(i, r.predicate, m[r.subject], m[r.object], m[0], m.start() + 1, m.end()) for i, t in enumerate(texts) for r in M.RULES for m in re.finditer(r.pattern, t)}
    got = M.matches(docs).collect()
    assert {(r.doc_id, r.predicate, r.subject, r.object, r.quote, r.position, r.stop) for r in got} == want
    assert all(texts[r.doc_id][r.position - 1 : r.stop] == r.quote for r in got)
    assert len({(r.predicate, r.category, r.confidence) for r in got}) > 90 and len(M.RULES) == 135
    assert {k for r in got for k in r.details} == {"duration", "date", "place", "teaching"}


def test_names_with_marks_titles_and_spellings(spark):
    rows = [("Lama Mārpa, Rinpoche", "marpa"), ("རྗེ་Tsong kha pa", "tsong kha pa"), ("mar pa", "mar pa"), ("Jeweller", "jeweller"), (None, None)]
    assert [r.n for r in spark.createDataFrame(rows, "a string, b string").select(N.normalised(F.col("a")).alias("n")).collect()] == [b for _, b in rows]
    m = lambda a, b: spark.range(1).select(N.match_type(F.lit(a), F.lit(b)).alias("m")).first().m
    assert (m("mar pa", "marpa").type, m("mar pa", "marpa").score, m("marpa", "marpa").type) == ("transliteration", 0.98, "exact")


FIELDS = "id string, type string, names array<string>, birth long, death long, affiliations array<string>, traditions array<string>, roles array<string>, gender string, region string, country string, place_type string, verified boolean"


def test_signals_of_unknown_fields(spark):
    none = ("a", "person", None, None, None, None, None, None, None, None, None, None, None)
    marpa = ("b", "person", ["Marpa", "mar pa"], 1012, 1097, ["x"], ["k"], ["t"], "m", None, None, None, True)
    place = ("c", "place", ["Lhasa"], None, None, None, None, None, None, "u", "t", "city", False)
    pairs = spark.createDataFrame([(none, none), (marpa, marpa), (none, marpa), (place, place), (marpa, place)], f"a struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>, b struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    got = [(r.signals.name, r.signals.date, r.signals.location, r.signals.attribute, r["class"]) for r in S.compared(pairs).collect()]
    assert got[0][:4] == (0.0, 0.5, 0.5, 0.5) and got[1] == (1.0, 1.0, 1.0, 1.0, "very_high") and got[3][1:4] == (0.5, 0.8, 1.0) and got[4][2:4] == (0.5, 0.5)
    assert S.conflicts(pairs.where("a.id is null")).count() == 0


def test_merge_and_undo(spark):
    nodes = spark.createDataFrame([(x, "active") for x in "abcdefgh"], "id string, merge_status string")
    edges = spark.createDataFrame([("1", "a", "t", "b", 0.9), ("2", "b", "t", "c", 0.8), ("3", "a", "t", "d", 0.7), ("4", "c", "t", "d", 0.9), ("5", "d", "t", "e", 0.6), ("6", "e", "t", "e", 0.5)], "id string, src string, predicate string, dst string, confidence double")
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), ("z", "d"), (None, "d"), ("f", "g"), ("g", "f"), ("g", "h")], "primary string, duplicate string")
    after, moved, history, log = S.merge_applied(nodes, edges, merges)
    assert {r.id for r in after.where("merge_status = 'merged'").collect()} == set("bcgh")  # c by way of b; of the circle of f and g the first stays
    assert {(r.duplicate, r.primary) for r in history.collect()} == {("b", "a"), ("c", "a"), ("g", "f"), ("h", "f")}
    assert {(r.id, r.src, r.dst) for r in moved.collect()} == {("3", "a", "d"), ("5", "d", "e"), ("6", "e", "e")}  # the own edge a to d stays in place of c's
    # A later merge takes d into e; undone in turn, everything is as it was.
    later = S.merge_applied(after, moved, spark.createDataFrame([("e", "d")], "primary string, duplicate string"))
    assert {(r.id, r.src, r.dst) for r in later[1].collect()} == {("3", "a", "e"), ("6", "e", "e")}
    early = S.merge_undone(later[0], later[1], history, log)  # out of turn: what the later merge touched is left to it
    assert ("3", "a", "e") in {(r.id, r.src, r.dst) for r in early[1].collect()}
    back = S.merge_undone(*later)
    back = S.merge_undone(*back, history, log)
    assert {tuple(r) for r in back[0].collect()} == {tuple(r) for r in nodes.collect()} and {tuple(r) for r in back[1].collect()} == {tuple(r) for r in edges.collect()}


def test_a_long_chain_and_circles_of_merges(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(70)]
    circle = [(f"k{i}", f"k{(i + 1) % 5}") for i in range(5)] + [("k3", "a-tail"), ("a-tail", "b-tail")]
    got = {r.duplicate: r.primary for r in S.last_primaries(spark.createDataFrame(chain + circle, "primary string, duplicate string")).collect()}
    assert got == {d: "000" for _, d in chain} | {f"k{i}": "k0" for i in range(1, 5)} | {"a-tail": "k0", "b-tail": "k0"}
    assert S.last_primaries(spark.createDataFrame([], "primary string, duplicate string")).count() == 0


def test_mentions_lose_no_name_over_the_limit(spark):
    rng = random.Random(3)
    letters = "abcdeimnoprst"
    names = ["milarepa", "marpa", "a", "ab", "abcd", *("".join(rng.choice(letters) for _ in range(rng.randint(3, 24))) for _ in range(60))]

    def misspelled(w):
        for _ in range(rng.randint(0, 1 + len(w) // 5)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice((w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]))
        return w

    said = sorted({"nilarepa", *(misspelled(n) for n in names * 4)} - {""})
    got = {r.mention: (r.id, r.score) for r in M.resolved_mentions(spark.createDataFrame([(m,) for m in said], "mention string"), spark.createDataFrame([(n, n, 0.5) for n in names], "id string, name string, confidence double")).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for m in said:
        best = min((edits(m, n) / max(len(m), len(n)), n) for n in names)
        if round(1 - best[0], 9) > 0.8:
            want[m] = (best[1], round(1 - best[0], 6))
    assert got == want and got["nilarepa"] == ("milarepa", 0.875)


def test_tibetan_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(C.syllables(F.lit("བླ་མ་དམ་པ། ཆོས་"))) == ["བླ", "མ", "དམ", "པ", "ཆོས"]
    assert one(C.keywords(F.lit("བླ་མ་དང་ lama བླ་"))) == ["བླ", "མ"]
    assert one(C.ocr_clean(F.lit("བླ.མ | ~ དམ་་པ"))) == "བླ་མ ། དམ་པ"
    assert one(C.term_pairs(F.lit("the great perfection (རྫོགས་ཆེན) and (none)")))[0].term == "རྫོགས་ཆེན"
    assert one(C.script_ratio(F.lit(""))) == 0 and one(C.fitting_prefix(F.lit("one two three four"), 4)) == "one two three"
    assert one(C.annotated_once(F.lit("a lama, a lama"), F.lit("lama"), F.lit("བླ་མ"))) == "a lama (བླ་མ), a lama"
    assert one(C.output_issues(F.lit("བླ་མ"), F.lit("I cannot do (this"))) == ["refusal", "unbalanced_brackets", "script_lost", "unfinished"]
    assert one(C.format_corrected(F.lit("Here is it:\n## The **lama** ( )"))) == "The lama"
