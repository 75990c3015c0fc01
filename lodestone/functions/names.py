"""Similarity of names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Honorifics that are no part of a name.
HONORIFICS = ("rinpoche", "lama", "je", "rje", "རིན་པོ་ཆེ", "བླ་མ", "རྗེ", "lotsawa", "པཎ་ཆེན", "panchen", "dalai", "དལའི", "khenpo", "མཁན་པོ", "geshe", "དགེ་བཤེས", "tulku", "སྤྲུལ་སྐུ")
#: Letters with marks and what they are without.
MARKED = ("āīūṛṝḷḹēōṃṁḥñṅṇṭḍśṣéèêëáàâäãíìîïóòôöõúùûüçÿ", "aiurrlleommhnnntdsseeeeaaaaaiiiiooooouuuucy")
#: Spellings by letter and what they sound like.
SPELLINGS = {
    "bla ma": ("lama",), "mar pa": ("marpa",), "mi la": ("milarepa", "mila"), "sgam po pa": ("gampopa",), "tsong kha pa": ("tsongkhapa", "je tsongkhapa"), "pad+ma": ("padma", "pema"), "sa skya": ("sakya",), "dge lugs": ("gelug", "geluk"),
    "rnying ma": ("nyingma",), "bka' brgyud": ("kagyu", "kagyü"), "jo bo rje": ("atisha", "jowo je"), "tā la'i bla ma": ("dalai lama",),
}
#: Codes of a phonetic key by letter.
SOUNDS = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}


def normalised(name: Column) -> Column:
    """Lower case without marks, honorifics and punctuation, single blanks. Null is null."""
    out = F.translate(F.lower(F.trim(name)), *MARKED)
    out = F.regexp_replace(out, r"(?<![a-z])(" + "|".join(HONORIFICS) + r")(?![a-z])", " ")
    out = F.regexp_replace(out, r"[.,;:!?'\"()\[\]_\-་-༔]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / the longer length; two empty names are alike."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longer, F.lit(1)))


def phonetic_key(word: Column) -> Column:
    """First letter and three digits; any letter without a code, h and w too, parts equal codes; no letters give 0000."""
    letters = F.regexp_replace(F.upper(word), "[^A-Z]", "")
    codes = "".join(next((d for group, d in SOUNDS.items() if c in group), "0") for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    coded = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", codes)
    single = F.regexp_replace(coded, r"(\d)\1+", "$1")
    rest = F.regexp_replace(F.substring(single, 2, 1000), "0", "")
    return F.when(letters == "", "0000").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), rest), 4, "0"))


def words(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")


def phonetic_similarity(a: Column, b: Column) -> Column:
    """Words of a with a word in b of the same key, over the larger number of words."""
    keys = F.transform(words(b), phonetic_key)
    hits = F.size(F.filter(words(a), lambda w: F.array_contains(keys, phonetic_key(w))))
    most = F.greatest(F.size(words(a)), F.size(words(b)))
    return F.when(most > 0, hits / F.greatest(most, F.lit(1))).otherwise(0.0)


def word_overlap(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1))).otherwise(0.0)


def length_penalty(a: Column, b: Column) -> Column:
    short, long = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    ratio = short / F.greatest(long, F.lit(1))
    return F.when(short == 0, 0.5).when(ratio >= 0.7, 1.0).when(ratio >= 0.5, 0.95).when(ratio >= 0.3, 0.85).otherwise(0.7)


def same_spelling(a: Column, b: Column) -> Column:
    """.98 where one name has a spelling by letter and the other what it sounds like, else 0."""
    has = lambda name, forms: F.coalesce(name.rlike("|".join(rf"\Q{f}\E" for f in forms)), F.lit(False))
    met = F.lit(False)
    for letters, sounds in SPELLINGS.items():
        met = met | (has(a, (letters,)) & has(b, sounds)) | (has(b, (letters,)) & has(a, sounds))
    return F.when(met, 0.98).otherwise(0.0)


def name_similarity(a: Column, b: Column) -> Column:
    """0..1: 1 for equal names after normalising, .98 for two spellings of one; else edits, sounds and words by weight, less a
    penalty for unlike lengths."""
    mixed = (0.5 * edit_similarity(a, b) + 0.2 * phonetic_similarity(a, b) + 0.2 * word_overlap(a, b)) * length_penalty(a, b)
    return F.when(a == b, 1.0).when(same_spelling(a, b) > 0.95, 0.98).otherwise(mixed)


def match_type(a: Column, b: Column) -> Column:
    """Struct (type, score, confidence): how two normalised names are alike."""
    s, spelled, sounds = name_similarity(a, b), same_spelling(a, b), phonetic_similarity(a, b)
    kind = F.when(a == b, "exact").when(spelled > 0.95, "transliteration").when(sounds > 0.8, "phonetic").when(word_overlap(a, b) > 0.7, "word").otherwise("fuzzy")
    return F.struct(kind.alias("type"), F.round(s, 6).alias("score"), F.round(s * F.when(kind == "exact", 1.0).when(kind == "transliteration", 0.95).otherwise(0.9), 6).alias("confidence"))


def best_of_variants(a: Column, b: Column) -> Column:
    """The highest similarity of any name of one array with any of the other; null where either has none."""
    scores = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: name_similarity(normalised(x), normalised(y)))))
    return F.array_max(scores)


def set_overlap(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays, null being empty; null where both are empty."""
    x, y = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def mean_known(*signals: Column) -> Column:
    """The mean of the signals that are not null; .5 where all are."""
    known = F.array_compact(F.array(*signals))
    return F.when(F.size(known) == 0, 0.5).otherwise(F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(known), F.lit(1)))


def similarity_class(s: Column) -> Column:
    return F.when(s >= 0.95, "very_high").when(s >= 0.85, "high").when(s >= 0.75, "medium").when(s >= 0.5, "low").otherwise("none")


def year_similarity(a: Column, b: Column) -> Column:
    """By distance in years; unknown years say nothing: 0.5."""
    d = F.abs(a - b)
    return F.when(d.isNull(), 0.5).when(d == 0, 1.0).when(d <= 5, 0.85).when(d <= 10, 0.7).when(d <= 20, 0.5).otherwise(0.0)
