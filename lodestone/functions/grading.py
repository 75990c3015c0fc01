"""Grades of translations from the two texts alone: a confidence of seven signals, and five aspects with a grade and advice.

Column expressions; the script, the marks of its punctuation and the listed terms are parameters, so that any language can be
graded. Null texts are empty ones. Lengths are in characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import TIBETAN

MARKS = r"[\x{0F0D}\x{0F0E}\x{0F11}]"
# Openings that tell of a translation instead of giving one, and signs of a failed answer.
OPENINGS = ("translation:", "here is", "i have translated", "output:", "result:")
ANYWHERE = "the translation is:"
FAILURES = ("Error:", "Failed:", "I cannot", "I apologize")
# Terms that are to be written with a capital.
TERMS = ("bodhisattva", "dharma", "buddha", "sangha", "karma", "samsara", "nirvana", "enlightenment", "meditation", "compassion", "wisdom", "emptiness", "mindfulness", "refuge", "precepts", "merit", "dedication")
# Clumsy wordings; each kind counts once.
AWKWARD = ("the which|in which the|of the which", "is being|are being", "that that", "of of")
BLANKS = " \t\n\x0b\f\r"
WORD = "[A-Za-z0-9_]"
CAPITALS = rf"(?<!{WORD})[A-Z][a-z]+(?!{WORD})(?:\s+[A-Z][a-z]+(?!{WORD}))*+"
BRACKETS = r"\([^)]*\)"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return a / F.when(b > 0, b)


def _pieces(text: Column) -> Column:
    """What stands between runs of . ! and ?, blank pieces left out."""
    return F.filter(F.split(text, "[.!?]+"), lambda s: s.rlike(r"\S"))


def _clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def quoted(script: str = TIBETAN) -> str:
    """The pattern of brackets that hold a character of the script."""
    return rf"\([^)]*{script}[^)]*\)"


def punctuation_kept(original: Column, translation: Column, script: str = TIBETAN, marks: str = MARKS) -> Column:
    """How much of the original's punctuation stands in the translation's quotes of it: 1 where there was none; the share kept, at
    most 1, less .1 for each mark of difference up to .3, not under 0."""
    had = _count(_text(original), marks)
    kept = _count(F.array_join(F.regexp_extract_all(_text(translation), F.lit(quoted(script)), F.lit(0)), " "), marks)
    return F.when(had == 0, 1.0).otherwise(F.greatest(F.least(_ratio(kept, had), F.lit(1.0)) - F.least(F.abs(had - kept) * 0.1, F.lit(0.3)), F.lit(0.0)))


def form(translation: Column, script: str = TIBETAN) -> Column:
    """1 less .3 for brackets that don't pair, .2 for talk about the translation, .2 for over two characters of the script outside
    brackets, .1 for more than 50 characters without a sentence's end and .1 for over three brackets that follow each other."""
    t = _text(translation)
    said = F.lower(F.btrim(t, F.lit(BLANKS)))
    talk = said.contains(ANYWHERE)
    for opening in OPENINGS:
        talk = talk | said.startswith(opening)
    less = [
        (_count(t, r"\(") != _count(t, r"\)"), 0.3), (talk, 0.2), (_count(F.regexp_replace(t, BRACKETS, ""), script) > 2, 0.2),
        (~t.rlike("[.!?]") & (F.char_length(t) > 50), 0.1), (_count(t, r"\)\s*\(") > 3, 0.1),
    ]
    out = F.lit(1.0)
    for bad, by in less:
        out = out - F.when(bad, by).otherwise(0.0)
    return F.greatest(out, F.lit(0.0))


def text_confidence(translation: Column, original: Column, coverage: Column | None = None, script: str = TIBETAN, marks: str = MARKS) -> Column:
    """.5 and: .025 for each quote of the original up to .15; .15 of the share of sentences that hold one; .1 for a length of half to
    three times the original's, .05 for .3 to 4 times; .05 without a sign of failure; .15 of the share of known terms rendered
    (coverage; left out where it is not given); .1 of punctuation_kept and .1 of form. From .1 to .98.
    """
    t, o, q = _text(translation), _text(original), quoted(script)
    whole = _pieces(t)
    ratio = _ratio(F.char_length(F.regexp_replace(t, BRACKETS, "")), F.char_length(o))
    failed = F.lit(False)
    for sign in FAILURES:
        failed = failed | t.contains(sign)
    out = 0.5 + F.least(_count(t, q) * 0.025, F.lit(0.15)) + 0.15 * F.coalesce(_ratio(F.size(F.filter(whole, lambda s: s.rlike(q))), F.size(whole)), F.lit(0.0))
    out = out + F.when(ratio.between(0.5, 3), 0.1).when(ratio.between(0.3, 4), 0.05).otherwise(0.0) + F.when(failed, 0.0).otherwise(0.05)
    if coverage is not None:
        out = out + 0.15 * F.coalesce(coverage, F.lit(0.5))
    return _clip(out + 0.1 * punctuation_kept(o, t, script, marks) + 0.1 * form(t, script), 0.1, 0.98)


def consensus_confidence(translation: Column, original: Column, mean_confidence: Column, script: str = TIBETAN, marks: str = MARKS) -> Column:
    """.7, .2 of the answers' mean confidence, .3 of text_confidence and .1 where the original is quoted; from .3 to .95."""
    out = 0.7 + 0.2 * mean_confidence + 0.3 * text_confidence(translation, original, None, script, marks)
    return _clip(out + F.when(_text(translation).rlike(quoted(script)), 0.1).otherwise(0.0), 0.3, 0.95)


def usage(translation: Column, used: Column, script: str = TIBETAN) -> Column:
    """.7, .05 for each known term used up to .3, less .2 without a quote of the original."""
    return _clip(0.7 + F.least(F.coalesce(used, F.lit(0)) * 0.05, F.lit(0.3)) - F.when(_text(translation).rlike(quoted(script)), 0.0).otherwise(0.2), 0.0, 1.0)


def structure(translation: Column, original: Column) -> Column:
    """.8 less .2 where one text has under .8 of the other's sentences, .15 where under .7 of the sentences' ends are followed by
    brackets, and .1 more for list items."""
    t = _text(translation)
    here, there = _count(t, "[.!?]+"), _count(_text(original), "[.!?]+")
    apart = F.coalesce(_ratio(F.least(here, there), F.greatest(here, there)) < 0.8, F.lit(False))
    loose = F.coalesce(_ratio(_count(t, r"[.!?]\s*" + BRACKETS), here) < 0.7, F.lit(False))
    return _clip(0.8 - F.when(apart, 0.2).otherwise(0.0) - F.when(loose, 0.15).otherwise(0.0) + F.when(t.rlike(r"(?m)^\s*[*•-]"), 0.1).otherwise(0.0), 0.0, 1.0)


def terminology(translation: Column, terms: tuple[str, ...] = TERMS) -> Column:
    """.8 less .1, up to .3, for each listed term (lower case) that also stands there as capitalised words, and .1 where any stands there."""
    t = _text(translation)
    low = F.lower(t)
    held = F.filter(F.array(*[F.when(low.contains(x), x) for x in terms]), lambda x: x.isNotNull())
    capital = F.transform(F.regexp_extract_all(t, F.lit(CAPITALS), F.lit(0)), lambda x: F.lower(x))
    both = F.size(F.array_intersect(held, capital))
    return _clip(0.8 - F.least(both * 0.1, F.lit(0.3)) - F.when(F.size(held) > 0, 0.1).otherwise(0.0), 0.0, 1.0)


def completeness(translation: Column, original: Column, script: str = TIBETAN) -> Column:
    """.8 less .3 under half the original's length or .1 over three times it (brackets left out, blanks as one), .2 for an end that is
    no sentence's, .4 for five characters of the script in a row."""
    t, o = _text(translation), _text(original)
    length = lambda c: F.char_length(F.regexp_replace(c, r"\s+", " "))
    here, there = length(F.regexp_replace(t, BRACKETS, "")), length(o)
    size = F.when(here * 2 < there, 0.3).when(here > there * 3, 0.1).otherwise(0.0)
    broken = F.btrim(t, F.lit(BLANKS)).rlike(r"[^.!?]\z")
    return _clip(0.8 - size - F.when(broken, 0.2).otherwise(0.0) - F.when(t.rlike(script + "{5,}"), 0.4).otherwise(0.0), 0.0, 1.0)


def naturalness(translation: Column, most_words: int = 30, most_alike: int = 3) -> Column:
    """.7 less .05 for each kind of clumsy wording, .1 for sentences of over most_words words in the mean, .1 where over most_alike
    sentences begin with one word. Beginnings are sorted, so a long text takes n log n steps."""
    t = _text(translation)
    out = F.lit(0.7)
    for p in AWKWARD:
        out = out - F.when(t.rlike(rf"(?i)(?<!{WORD})(?:{p})(?!{WORD})"), 0.05).otherwise(0.0)
    each = _pieces(t)
    words = F.aggregate(each, F.lit(0), lambda s, x: s + F.regexp_count(x, F.lit(r"\s+")) + 1)
    first = F.array_sort(F.transform(each, lambda x: F.lower(F.regexp_extract(x, r"\S+", 0))))
    again = F.exists(F.zip_with(first, F.slice(first, most_alike + 1, F.greatest(F.size(first), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    return _clip(out - F.when(_ratio(words, F.size(each)) > most_words, 0.1).otherwise(0.0) - F.when(again, 0.1).otherwise(0.0), 0.0, 1.0)


def aspects(translation: Column, original: Column, used: Column, script: str = TIBETAN, terms: tuple[str, ...] = TERMS) -> dict[str, Column]:
    """The five aspects by name."""
    return {
        "usage": usage(translation, used, script), "structure": structure(translation, original), "terminology": terminology(translation, terms),
        "completeness": completeness(translation, original, script), "naturalness": naturalness(translation),
    }


WEIGHTS = {"usage": 0.2, "structure": 0.25, "terminology": 0.2, "completeness": 0.2, "naturalness": 0.15}
#: Below these an aspect (or all of them together) is to be worked on.
FLOORS = {"overall": 0.7, "usage": 0.6, "structure": 0.7, "terminology": 0.7, "completeness": 0.8, "naturalness": 0.6}


def overall(of: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for k, w in WEIGHTS.items():
        out = out + w * of[k]
    return F.round(out, 9)


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "Excellent").when(score >= 0.75, "Good").when(score >= 0.6, "Fair").otherwise("Poor")


def to_work_on(of: dict[str, Column]) -> Column:
    """Names of the aspects under their floors, in order, in one text."""
    return F.concat_ws(",", *[F.when(F.round(of[k], 9) < floor, k) for k, floor in FLOORS.items()])
