"""Checks, clean-up and heuristics for sources, transcripts and translations, as column expressions.

Script classes are parameters (see text.TIBETAN): what counts as the source's own script. Null texts are empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import TIBETAN, _text, token_estimate


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def _found(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in rules.items()]))


# Lengths and pieces


def fitting_prefix(text: Column, budget: int, script: str = TIBETAN) -> Column:
    """The longest run of whole words from a text's start whose token estimate fits the budget; found by halving.

    A word is a quarter of a token at least (only blanks at either end give empty ones), so no more than four for each token are looked at.
    """
    most = max(0, 4 * budget + 2)
    words = F.split(F.trim(_text(text)), r"\s+", most + 1)  # the last one may be all the rest, which is not looked at

    def longest(w: Column) -> Column:
        prefix = lambda n: F.array_join(F.slice(w, 1, n), " ")

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
            fits = token_estimate(prefix(mid), script) <= budget
            return F.struct(F.when(fits, mid).otherwise(s["low"]).alias("low"), F.when(fits, s["high"]).otherwise(F.greatest(mid - 1, s["low"])).alias("high"))

        steps = F.sequence(F.lit(1), F.lit(most.bit_length() + 1))
        return prefix(F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.least(F.size(w), F.lit(most)).alias("high")), halve, lambda s: s["low"]))

    return F.transform(F.array(words), longest)[0]  # so the text is split once, not at each halving


def sentence_overlap(chunks: DataFrame, keys: list[str], order: str, sentences: str, n: int = 2) -> DataFrame:
    """chunks with overlap: the last n sentences of the chunk before (array), empty for the first."""
    before = F.lag(sentences).over(Window.partitionBy(*keys).orderBy(order))
    tail = F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n)
    return chunks.withColumn("overlap", F.coalesce(F.when(F.size(before) > 0, tail), F.array().cast("array<string>")))


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text): texts cut at lines "Page N:"; what stands before the first such line is page 0. Blank pages go."""
    cut = F.split(F.concat(F.lit("\n"), _text(F.col("text"))), r"(?=\nPage \d+:)")
    parts = docs.select("doc_id", F.explode(cut).alias("t"))
    number = F.coalesce(F.nullif(F.regexp_extract("t", r"^\nPage (\d+):", 1), F.lit("")).try_cast("long"), F.lit(0))
    body = F.trim(F.regexp_replace("t", r"^\n(?:Page \d+:)?[ \n]*", ""))
    return parts.select("doc_id", number.alias("page"), body.alias("text")).where("text <> ''")


def page_artifacts(pages_: DataFrame, edge: int = 3, at_least: float = 0.5) -> DataFrame:
    """(doc_id, place, line, pages, confidence): lines among the first (header) or last (footer) of at_least of a document's pages.

    Digits count as one sign, so that page numbers are one line. Needs three pages.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.trim(x), r"\d+", "#")), lambda x: x != "")
    both = pages_.select("doc_id", "page", F.slice(lines, 1, edge).alias("header"), F.slice(F.reverse(lines), 1, edge).alias("footer"))
    seen = both.select("doc_id", "page", F.explode(F.create_map(F.lit("header"), "header", F.lit("footer"), "footer")).alias("place", "lines")).select("doc_id", "page", "place", F.explode("lines").alias("line")).distinct()
    total = pages_.groupBy("doc_id").agg(F.count_distinct("page").alias("all")).where(F.col("all") >= 3)
    by = seen.groupBy("doc_id", "place", "line").agg(F.count(F.lit(1)).alias("pages")).join(total, "doc_id").withColumn("share", F.col("pages") / F.col("all"))
    return by.where(F.col("share") >= at_least).select("doc_id", "place", "line", "pages", F.round("share", 6).alias("confidence"))


def fallback_pieces(text: Column) -> Column:
    """Two pieces of a text that was too long: its first two paragraphs of 20 characters or more, else sentences at a shad, else lines
    of 40, else its halves."""
    t = _text(text)
    long = lambda parts, n: F.slice(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.char_length(p) >= n), 1, 2)
    paragraphs, sentences, lines = long(F.split(t, r"\n\n+"), 20), long(F.split(t, "།"), 20), long(F.split(t, "\n"), 40)
    half = F.floor(F.char_length(t) / 2).cast("int")
    halves = F.array(F.substr(t, F.lit(1), half), F.substr(t, half + 1))
    return F.when(F.size(paragraphs) == 2, paragraphs).when(F.size(sentences) == 2, sentences).when(F.size(lines) == 2, lines).otherwise(halves)


# Characters


def syllables(text: Column) -> Column:
    """Array of syllables: what stands between tsek, shad and white space."""
    return F.filter(F.split(_text(text), r"[་༌།༎\s]+"), lambda s: s != "")


def script_ratio(text: Column, script: str = TIBETAN) -> Column:
    """The script's share of the characters that are not white space; 0 for none."""
    t = F.regexp_replace(_text(text), r"\s", "")
    return F.when(t == "", 0.0).otherwise(F.regexp_count(t, F.lit(script)) / F.greatest(F.char_length(t), F.lit(1)))


def character_entropy(docs: DataFrame) -> DataFrame:
    """(doc_id, n, entropy): characters of each text and their Shannon entropy in bits; texts without characters are left out.

    Characters are counted by document before anything else happens to them.
    """
    per = docs.select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("doc_id", "c").agg(F.count(F.lit(1)).alias("k"))
    by = per.groupBy("doc_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("s"))
    return by.select("doc_id", "n", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))


#: What scanners read wrongly, and what is meant.
CONFUSIONS = ((r"[|¦]", "།"), (r"(?<=[\x{0F40}-\x{0FBC}])[.·](?=[\x{0F40}-\x{0FBC}])", "་"), (r"།\s+།", "།།"), (r"་{2,}", "་"))


def ocr_clean(text: Column) -> Column:
    """A transcript with common confusions set right, stray signs and blanks beside tsek taken out."""
    out = _text(text)
    for wrong, right in CONFUSIONS:
        out = F.regexp_replace(out, wrong, right)
    out = F.regexp_replace(out, r"[~^`_\\]", "")
    out = F.regexp_replace(out, r"[ \t]*་[ \t]*", "་")
    return F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))


def ocr_quality(text: Column, confidence: Column, script: str = TIBETAN) -> Column:
    """.4 times the script's share and .5 times the confidence, less .1 for each kind of suspicious run, from 0 to 1."""
    t = _text(text)
    odd = sum((t.rlike(p).cast("int") for p in (r"[0-9]{10,}", r"[^\w\s]{5,}", r"[A-Z]{8,}")), F.lit(0))
    return _clamp(0.4 * script_ratio(t, script) + 0.5 * confidence - 0.1 * odd, 0.0, 1.0)


def ocr_needed(pages_: DataFrame, keys: list[str], sparse: int = 50) -> DataFrame:
    """(keys, pages, chars, needed, confidence, reason) of pages (keys, chars, images): whether a scan must be read anew."""
    by = pages_.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.avg((F.col("chars") < sparse).cast("int")).alias("share"), F.max(F.col("images") > 0).alias("images"))
    rules = [(F.col("chars") == 0, F.lit(1.0), "no text"), (F.col("chars") / F.col("pages") < sparse, F.lit(0.9), "little text"), (F.col("share") >= 0.3, F.least(F.lit(0.8), F.col("share")), "sparse pages"), (F.col("images") & (F.col("share") > 0.1), F.lit(0.7), "images")]
    confidence, reason = F.lit(0.0), F.lit("enough text")
    for holds, c, why in reversed(rules):
        confidence, reason = F.when(holds, c).otherwise(confidence), F.when(holds, why).otherwise(reason)
    return by.select(*keys, "pages", "chars", (reason != "enough text").alias("needed"), F.round(confidence, 6).alias("confidence"), reason.alias("reason"))


def chosen_source(native: Column, ocr: Column, pages_: Column, confidence: Column, script: str = TIBETAN, sparse: int = 50, acceptable: float = 0.7, least_chars: int = 100) -> Column:
    """Struct (method, text, quality) of a document's own text and a reading of its pages (null where that failed).

    native: the own text has `sparse` characters a page (trimmed), there are no pages, or the reading failed; hybrid: the reading is
    not acceptable by ocr_quality and there is some own text: then the longer-lived of both, the other one having under least_chars
    characters, or both under a heading; else ocr. quality is null for native ones. A null own text is empty.
    """
    own, read = _text(native), _text(ocr)
    length = lambda t: F.char_length(F.btrim(t, F.lit(" \t\n\x0b\f\r")))
    quality = F.when(ocr.isNotNull(), ocr_quality(read, F.coalesce(confidence, F.lit(0.0)), script))
    enough = (F.coalesce(pages_, F.lit(0)) == 0) | (length(own) >= sparse * pages_) | ocr.isNull()
    mixed = (quality < acceptable) & (length(own) > 0)
    both = F.when(length(own) < least_chars, read).when(length(read) < least_chars, own).otherwise(F.concat(own, F.lit("\n\n[OCR-Enhanced Content]\n\n"), read))
    return F.struct(F.when(enough, "native").when(mixed, "hybrid").otherwise("ocr").alias("method"), F.when(enough, own).when(mixed, both).otherwise(read).alias("text"), F.when(~enough, quality).alias("quality"))


# Terms


def term_pairs(text: Column, script: str = TIBETAN) -> Column:
    """Array of structs (english, term): up to four words before round brackets that hold the script."""
    pattern = rf"((?:[A-Za-z]+ ){{1,4}})\(([^()]*{script}[^()]*)\)"
    got = [F.transform(F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(g)), lambda s: F.trim(s)) for g in (1, 2)]
    return F.arrays_zip(got[0].alias("english"), got[1].alias("term"))


#: Words that put a term into a category; the first that fits counts.
CATEGORIES = {"person": ("lama", "master", "teacher", "king"), "place": ("monastery", "temple", "valley", "land"), "ritual": ("ritual", "offering", "empowerment", "rite"), "philosophy": ("emptiness", "mind", "wisdom", "view"), "text": ("sutra", "tantra", "treatise", "commentary")}


def term_category(english: Column, context: Column) -> Column:
    t = F.lower(F.concat_ws(" ", english, context))
    out = F.lit("general")
    for category, words in reversed(CATEGORIES.items()):
        out = F.when(t.rlike(r"\b(" + "|".join(words) + r")\b"), category).otherwise(out)
    return out


#: Particles that are no keywords.
PARTICLES = ("གི", "ཀྱི", "གྱི", "ཡི", "ལ", "ན", "ནས", "ལས", "དང", "ཏེ", "སྟེ", "དེ", "ནི", "ཡང", "ཀྱང", "གིས", "ཀྱིས", "གྱིས")


def keywords(text: Column, script: str = TIBETAN, stop: tuple[str, ...] = PARTICLES) -> Column:
    """Array of the distinct pieces between tsek, shad and white space that have a character of the script and are no particles."""
    return F.array_distinct(F.filter(syllables(text), lambda w: w.rlike(script) & ~w.isin(*stop)))


def keyword_overlap(a: Column, b: Column) -> Column:
    """Shared keywords over those of the larger set; 0 for none."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / F.greatest(most, F.lit(1))).otherwise(0.0)


def annotated_once(text: Column, term: Column, note: Column) -> Column:
    """The text with the note in brackets after the term's first occurrence; as it is without one."""
    t, at = _text(text), F.instr(_text(text), term)
    end = at + F.char_length(term) - 1
    return F.when((at > 0) & (term != ""), F.concat(F.substr(t, F.lit(1), end), F.lit(" ("), note, F.lit(")"), F.substr(t, end + 1))).otherwise(t)


# Formats


#: How a model talks about its answer.
META = r"(?im)^(?:here is|here's|sure|certainly|note:|translation:|i (?:have|can|will)|as an ai)[^\n]*\n?"


def format_issues(text: Column) -> Column:
    """Names of what is wrong with an answer's form."""
    t = _text(text)
    return _found({
        "meta_text": t.rlike(META), "code_block": t.contains("```"), "markdown": t.rlike(r"(?m)^#{1,6} |\*\*[^*]+\*\*|(?m)^[-*] "), "nested_brackets": t.rlike(r"\([^()]*\("), "unbalanced_brackets": F.regexp_count(t, F.lit(r"\(")) != F.regexp_count(t, F.lit(r"\)")),
        "empty_brackets": t.rlike(r"\(\s*\)"),
    })


def format_corrected(text: Column) -> Column:
    """The answer without talk about it, fences, marks of headings and bold type, and empty brackets."""
    out = F.regexp_replace(_text(text), META, "")
    for wrong, right in ((r"```[a-z]*\n?", ""), (r"(?m)^#{1,6} +", ""), (r"\*\*([^*]+)\*\*", "$1"), (r" *\(\s*\)", ""), (r"[ \t]{2,}", " ")):
        out = F.regexp_replace(out, wrong, right)
    return F.trim(out)


#: How a model declines.
REFUSALS = r"(?i)\b(i cannot|i can't|i'm sorry|i am unable|unable to translate|cannot assist)\b"


def output_issues(source: Column, output: Column, script: str = TIBETAN) -> Column:
    """Names of what is wrong with a translation beside its source: nothing there, too short or long, refusals, lost script."""
    s, o = _text(source), _text(output)
    ratio = F.char_length(o) / F.greatest(F.char_length(s), F.lit(1))
    outside = F.regexp_count(F.regexp_replace(o, r"\([^()]*\)", ""), F.lit(script))
    return _found({
        "empty": F.trim(o) == "", "too_short": (F.trim(o) != "") & (ratio < 0.3), "too_long": ratio > 5, "refusal": o.rlike(REFUSALS), "unbalanced_brackets": F.regexp_count(o, F.lit(r"\(")) != F.regexp_count(o, F.lit(r"\)")),
        "script_outside_brackets": outside > 0, "script_lost": (F.regexp_count(s, F.lit(script)) > 0) & (F.regexp_count(o, F.lit(script)) == 0), "unfinished": (F.trim(o) != "") & ~F.rtrim(o).rlike(r"[.!?)\"'’”]\z"),
    })


def validated(pairs: DataFrame, script: str = TIBETAN, fatal: tuple[str, ...] = ("empty", "refusal", "unbalanced_brackets")) -> DataFrame:
    """pairs (source, output, ...) with errors and warnings of all checks in stages, and valid where there is no error."""
    every = F.array_distinct(F.concat(output_issues(F.col("source"), F.col("output"), script), format_issues(F.col("output"))))
    out = pairs.withColumn("_every", every)
    return out.withColumns({"errors": F.filter("_every", lambda x: x.isin(*fatal)), "warnings": F.filter("_every", lambda x: ~x.isin(*fatal)), "valid": F.size(F.filter("_every", lambda x: x.isin(*fatal))) == 0}).drop("_every")


def spaced(text: Column) -> Column:
    """Even spacing: none before marks, one after them, one between words, at most one blank line, no blanks at line ends."""
    out = _text(text)
    for wrong, right in ((r"[ \t]+", " "), (r" ([,.;:!?])", "$1"), (r"([,;:!?])([A-Za-z])", "$1 $2"), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"\( +", "("), (r" +\)", ")")):
        out = F.regexp_replace(out, wrong, right)
    return F.trim(out)


# Confidence


def bracketed_terms(text: Column, script: str = TIBETAN) -> Column:
    return F.regexp_count(_text(text), F.lit(rf"\([^)]*{script}[^)]*\)"))


def refinement_confidence(output: Column, source: Column, script: str = TIBETAN) -> Column:
    """.7, up to .2 for bracketed terms (.04 each), .2 times the share of sentences that have one, .15 for a fitting length, .05
    without error words; from .2 to .95."""
    o, s = _text(output), _text(source)
    sentences = F.filter(F.split(o, r"[.!?]+"), lambda x: F.trim(x) != "")
    with_term = F.size(F.filter(sentences, lambda x: x.rlike(rf"\([^)]*{script}[^)]*\)")))
    ratio = F.char_length(F.regexp_replace(o, r"\([^)]*\)", "")) / F.greatest(F.char_length(s), F.lit(1))
    parts = F.least(F.lit(0.2), 0.04 * bracketed_terms(o, script)) + F.when(F.size(sentences) > 0, 0.2 * with_term / F.greatest(F.size(sentences), F.lit(1))).otherwise(0.0)
    parts = parts + F.when(ratio.between(0.7, 2.5) & (s != ""), 0.15).otherwise(0.0) + F.when(o.contains("Error:") | o.contains("Failed:"), 0.0).otherwise(0.05)
    return _clamp(0.7 + parts, 0.2, 0.95)


def helper_confidence(output: Column, base: float = 0.7, script: str = TIBETAN) -> Column:
    """base, .02 for each bracketed term, .05 for brackets after a sentence, less .1 under 5 words or .05 over 500; from .1 to .95."""
    o = _text(output)
    n = F.size(F.split(o, r"\s+"))
    return _clamp(base + 0.02 * bracketed_terms(o, script) + F.when(o.rlike(r"[.!?]\s*\([^)]*\)"), 0.05).otherwise(0.0) - F.when(n < 5, 0.1).when(n > 500, 0.05).otherwise(0.0), 0.1, 0.95)


#: Weights and least values of the gates of a translation.
GATES = {"confidence": (0.3, 0.7), "format": (0.25, 0.7), "length": (0.15, 0.7), "preservation": (0.2, 0.7), "agreement": (0.1, 0.6)}


def length_gate(ratio: Column) -> Column:
    return F.when(ratio.between(0.5, 3.0), 1.0).when(ratio.between(0.3, 5.0), 0.7).when(ratio.between(0.2, 8.0), 0.4).otherwise(0.3)


def weighted_gates(scores: dict[str, Column]) -> Column:
    """Struct (score, failed) of the gates by name: the weighted mean of those that have a value, and the names under their least value."""
    weight = {k: F.when(c.isNotNull(), GATES[k][0]).otherwise(0.0) for k, c in scores.items()}
    total = sum(weight.values(), F.lit(0.0))
    mean = sum((F.coalesce(c, F.lit(0.0)) * weight[k] for k, c in scores.items()), F.lit(0.0)) / F.when(total > 0, total)
    return F.struct(F.round(mean, 6).alias("score"), _found({k: c < GATES[k][1] for k, c in scores.items()}).alias("failed"))


def pairwise_agreement(answers: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, n, agreement): mean likeness (shared words of all) of each two answers to one question; 1 for a single answer.

    Answers to one question come from a handful of models; their pairs are formed within the question only.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(_text(F.col(text))), r"\s+"), lambda w: w != ""))
    own = answers.select(*keys, F.struct(F.monotonically_increasing_id().alias("i"), words.alias("w")).alias("x"))
    by = own.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("all"))
    alike = lambda x, y: F.when(F.size(F.array_union(x["w"], y["w"])) > 0, F.size(F.array_intersect(x["w"], y["w"])) / F.size(F.array_union(x["w"], y["w"]))).otherwise(1.0)
    pairs = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: y["i"] > x["i"]), lambda y: alike(x, y))))
    n = F.size("all")
    mean = F.when(n == 1, 1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(pairs), F.lit(1)))
    return by.select(*keys, n.cast("long").alias("n"), F.round(mean, 6).alias("agreement"))


def gram_cosine(a: Column, b: Column, n: int = 3) -> Column:
    """Cosine of two texts' sets of character n-grams; 0 where either has none."""
    grams = lambda t: F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n))), lambda g: F.char_length(g) == n))
    x, y = grams(F.lower(_text(a))), grams(F.lower(_text(b)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.sqrt(F.greatest(F.size(x) * F.size(y), F.lit(1)).cast("double"))).otherwise(0.0)
