"""Texts against each other: sentences aligned in order, a consensus by aligned sentences, and likeness by words, trigrams and edits.

Every pair of texts is a row; tasks work on rows one by one, and a row needs memory for its own two texts only. What several
helpers say of one sentence meets by the sentence, never as whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.types as S
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Least confidence of a helper, likeness from which sentences agree, that from which a helper's own words are taken,
#: and that from which an unplaced sentence counts as the counterpart.
MIN_CONFIDENCE, AGREE, TAKE, COUNTERPART = 0.3, 0.7, 0.8, 0.3
#: A sentence ends here; a bracket that holds the original script.
SENTENCE_END, ORIGINAL = r"(?<=[.!?])\s+(?=[A-Z])", r"\(([^)]*[ༀ-࿿][^)]*)\)"
#: Weights of shared words, trigrams and token edits, and what parts tokens.
WEIGHTS, TOKENS = (0.5, 0.3, 0.2), r"[\s,.!?;:()\[\]{}]+"


def sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in re.split(SENTENCE_END, text)) if s] or [text]


def original(sentence: str) -> str:
    m = re.search(ORIGINAL, sentence)
    return m[1] if m else ""


def plain(sentence: str) -> str:
    return re.sub(r"\s*" + ORIGINAL, "", sentence).strip()


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Shared words over all words of each sentence of a with each of b, in lower case, without the bracketed original."""
    sets = [[frozenset(re.split(r"\s+", p.lower())) if (p := plain(s)) else frozenset() for s in x] for x in (a, b)]
    number: dict[str, int] = {}
    at = [[[number.setdefault(w, len(number)) for w in s] for s in x] for x in sets]
    out = np.zeros((len(a), len(b)))
    where: dict[int, list[int]] = {}
    for j, ws in enumerate(at[1]):
        for w in ws:
            where.setdefault(w, []).append(j)
    for i, ws in enumerate(at[0]):
        for w in ws:
            out[i, where.get(w, [])] += 1
    sizes = np.array([len(s) for s in sets[0]])[:, None] + np.array([len(s) for s in sets[1]])[None]
    return np.divide(out, sizes - out, out=np.zeros_like(out), where=out > 0)


def aligned(like: np.ndarray) -> list[int]:
    """For each row the column that it stands with, -1 for none: the pairs, in order on both sides, of the highest sum of likeness.

    Of equal sums rows are left out from the end first, then columns.
    """
    n, m = like.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        row = np.maximum(best[i, 1:], best[i, :-1] + like[i])
        best[i + 1, 1:] = np.maximum.accumulate(row)
    out, i, j = [-1] * n, n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out[i] = j
    return out


def by_place(like: np.ndarray, of: list[str], others: list[str]) -> list[int]:
    """For each sentence the one at its place; past the end the first that holds its original, else the most alike over COUNTERPART."""
    out = []
    for i, s in enumerate(of):
        at = i if i < len(others) else -1
        if at < 0 and (o := original(s)):
            at = next((j for j, x in enumerate(others) if o in x), -1)
        if at < 0 and len(others) and like[i].max() > COUNTERPART:
            at = int(like[i].argmax())
        out.append(at)
    return out


def aligned_sentences(pairs: DataFrame, method: str = "global") -> DataFrame:
    """(key, helper, pos, sentence, original, other, similarity) for each row of pairs (key, helper, text, other_text) and sentence of text.

    method `global` aligns both sides in order (aligned), `place` goes by the place (by_place). other is null where a
    sentence has no counterpart. Null texts have no sentences.
    """
    keep = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("key", "helper")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pos, text, orig, other, sim = [], [], [], [], [], []
            for k, (x, y) in enumerate(zip(b.column("text").to_pylist(), b.column("other_text").to_pylist(), strict=True)):
                if not x:
                    continue
                mine, theirs = sentences(x), sentences(y) if y else []
                like = likeness(mine, theirs)
                at = (aligned(like) if method == "global" else by_place(like, mine, theirs)) if theirs else [-1] * len(mine)
                row += [k] * len(mine)
                pos += range(len(mine))
                text += mine
                orig += [original(s) for s in mine]
                other += [theirs[j] if j >= 0 else None for j in at]
                sim += [float(like[i, j]) if j >= 0 else 0.0 for i, j in enumerate(at)]
            columns = [pa.array(pos, pa.int32()), pa.array(text, pa.string()), pa.array(orig, pa.string()), pa.array(other, pa.string()), pa.array(sim, pa.float64())]
            who = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key").take(who), b.column("helper").take(who), *columns], names=["key", "helper", "pos", "sentence", "original", "other", "similarity"])

    return pairs.select("key", "helper", "text", "other_text").mapInArrow(run, ", ".join([*keep, "pos int, sentence string, original string, other string, similarity double"]))


@pandas_udf(S.StringType())
def _without_original(s: pd.Series) -> pd.Series:
    return s.map(plain, na_action="ignore")


def consensus(base: DataFrame, helpers: DataFrame, method: str = "global") -> DataFrame:
    """(key, text, agreement, confidence) for each row of base (key, text, confidence), by helpers (key, helper, text, confidence).

    Helpers under MIN_CONFIDENCE or with blank texts do not count. Each base sentence meets its counterparts; the most alike
    one (of equals the smallest helper) decides: from TAKE on, and with a confidence over TAKE, its words are taken and the base's
    bracketed original is put after them if it lacks it; from AGREE on the base's stay and .8 of the likeness counts; under it
    the likeness counts. Without counterparts a sentence agrees with itself. Confidence is .4 of the base's and .6 of the
    helpers' mean, plus .2 of the agreement, less .1 where that is under .5, from .1 to .98; with helpers that do not count it is
    .9 of the base's, without any it is the base's. Keys of base are unique; a null or blank base text stays as it is.
    """
    sound = helpers.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    real = base.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("key", "text")
    pairs = real.join(sound.select("key", "helper", F.col("text").alias("other_text"), F.col("confidence").alias("sure")), "key")
    found = aligned_sentences(pairs, method).join(sound.select("key", "helper", F.col("confidence").alias("sure")), ["key", "helper"])
    first = F.min_by(F.struct("other", "similarity", "sure"), F.when(F.col("other").isNotNull(), F.struct((-F.col("similarity")).alias("s"), F.col("helper"))))
    voted = found.groupBy("key", "pos", "sentence", "original").agg(first.alias("b"))
    sim = F.col("b.similarity")
    whole = F.when((F.col("original") == "") | F.contains("b.other", "original"), F.col("b.other")).otherwise(F.concat(_without_original("b.other"), F.lit(" ("), "original", F.lit(")")))
    taken = (sim > TAKE) & (F.col("b.sure") > TAKE)
    said = voted.select("key", "pos", F.when(taken, whole).otherwise(F.col("sentence")).alias("t"), F.when(sim.isNull(), 1.0).when((sim >= AGREE) & ~taken, sim * 0.8).otherwise(sim).alias("a"))
    texts = said.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias("joined"), (F.sum("a") / F.count(F.lit(1))).alias("agreement"))
    means = sound.groupBy("key").agg(F.avg("confidence").alias("mean"))
    asked = helpers.select("key").distinct().withColumn("asked", F.lit(True))
    every = base.select("key", "text", "confidence").join(texts, "key", "left").join(means, "key", "left").join(asked, "key", "left")
    mixed = 0.4 * F.col("confidence") + 0.6 * F.col("mean") + 0.2 * F.col("agreement") - F.when(F.col("agreement") < 0.5, 0.1).otherwise(0.0)
    sure = F.when(F.col("agreement").isNotNull(), F.least(F.lit(0.98), F.greatest(F.lit(0.1), mixed))).when(F.col("asked"), F.col("confidence") * 0.9).otherwise(F.col("confidence"))
    return every.select("key", F.trim(F.coalesce("joined", "text")).alias("text"), F.round(F.coalesce("agreement", F.lit(1.0)), 6).alias("agreement"), F.round(sure, 6).alias("confidence"))


def token_edits(a: list, b: list) -> int:
    """Edit distance of two lists, within a band about the diagonal that is widened until the distance fits it."""
    low, m, n = 0, len(a), len(b)
    while low < min(m, n) and a[low] == b[low]:
        low += 1
    while m > low and n > low and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    number: dict = {}
    x, y = (np.array([number.setdefault(t, len(number)) for t in s], np.int64) for s in (a[low:m], b[low:n]))
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return len(y)
    band = max(16, len(y) - len(x))
    while True:
        # Row i holds the cells of columns i - band .. i + band + (the difference in length).
        width = 2 * band + len(y) - len(x) + 1
        far, place = len(x) + len(y) + 1, np.arange(width)
        column = place - band
        row = np.where((column >= 0) & (column <= len(y)), column, far)
        for i in range(1, len(x) + 1):
            column = place - band + i
            inside = (column >= 1) & (column <= len(y))
            diagonal = row + (y[np.clip(column - 1, 0, len(y) - 1)] != x[i - 1])
            above = np.append(row[1:], far) + 1
            new = np.where(inside, np.minimum(diagonal, above), far)
            new[column == 0] = i
            row = np.minimum.accumulate(new - place) + place
            row[(column < 0) | (column > len(y))] = far
        distance = int(row[len(y) - len(x) + band])
        if distance <= band or band >= len(y):
            return distance
        band = min(2 * band, len(y))


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(TOKENS, text) if t]


def _ratio(shared: float, a: int, b: int, of: float) -> float:
    return 1.0 if not a and not b else 0.0 if not a or not b else shared / of


def text_likeness(a: str, b: str) -> tuple[float, float, float, float]:
    """Likeness of two texts, 0 to 1: over all, by shared words, by the cosine of their trigrams, by edits of tokens; in lower case."""
    a, b = a.lower(), b.lower()
    x, y = _tokens(a), _tokens(b)
    u, v = set(x), set(y)
    words = _ratio(len(u & v), len(u), len(v), len(u | v) or 1)
    g, h = (Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in (re.sub(r"\s+", " ", s).strip() for s in (a, b)))
    norm = (sum(n * n for n in g.values()) * sum(n * n for n in h.values())) ** 0.5
    grams = _ratio(sum(n * h[k] for k, n in g.items()), len(g), len(h), norm or 1)
    edits = _ratio(1.0, len(x), len(y), 1.0) and 1 - token_edits(x, y) / (max(len(x), len(y)) or 1)
    return sum(w * s for w, s in zip(WEIGHTS, (words, grams, edits), strict=True)), words, grams, edits


@pandas_udf(S.StructType([S.StructField(f, S.DoubleType()) for f in ("likeness", "words", "trigrams", "edits")]))
def _likeness(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_likeness(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["likeness", "words", "trigrams", "edits"])


def texts_alike(a: Column, b: Column) -> Column:
    """Struct (likeness, words, trigrams, edits); a null text is an empty one, two empty ones are alike."""
    return _likeness(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
