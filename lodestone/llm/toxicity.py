"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= j | x) = sigmoid(theta_j - w.x), with one weight vector w for all thresholds theta_0 < theta_1 < ... The
features are hashed words and word beginnings of 4 to 7 bytes, weighted log(1 + 1000 * count / (words + 50)). The model gives P(grade >= 1), the most
probable grade and the expected severity, sum of j * P(grade = j).

Labels tell only toxic or not. Grades of toxic documents come from the sample itself: words that are much more frequent
in toxic than in other documents form a lexicon, and the toxic documents' density of such words is cut at its terciles
into the grades 1 to 3. Grade 0 is not toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textarrays as T
from lodestone.llm.common import lean, put_back, saved, set_aside, without

BITS = 20


@dataclass
class Fit:
    """Fit on at most sample_rows labelled documents: of each label up to half, those with the smallest hash of their id, and
    what one label leaves open for the other. Where a label is drawn more sparsely than the other its documents count for more.

    Of labelled documents only their features that are among the chosen ones or in the lexicon reach the driver.
    """

    sample_rows: int = 8000
    grades: int = 4
    steps: int = 500
    l1: float = 2e-4
    features: int = 4096
    min_docs: int = 6
    lexicon_ratio: float = 30.0


@dataclass
class Model:
    features: np.ndarray
    """Sorted feature ids with a weight."""
    weights: np.ndarray
    thresholds: np.ndarray
    reject: float = 0.5
    """The chance of a toxic grade from which on a document is rejected."""

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.features] = self.weights
        return dense

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Of each grade; a row for each score."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        edge = np.zeros((len(score), 1))
        return np.diff(np.hstack([edge, below, edge + 1]), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: Bytes that can stand at a word's ends and are no part of it.
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?\"'()[]#$%&*|"]] = True
#: Lengths in bytes of the word beginnings that are features besides whole words.
PREFIXES = (4, 5, 6, 7)


def _feature_counts(chunk: T.Chunk, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text and distinct feature: text index, feature id, count; and the words of each text. Marks count as space.

    With weights, only features that have one.
    """
    data = chunk.data
    if len(data):
        data = np.where(_MARKS[data], np.uint8(32), data)
    w = T.words(T.Chunk(chunk.first, data, chunk.offsets), PREFIXES)
    per = np.diff(w.offsets)
    text = np.repeat(np.arange(len(per), dtype=np.uint64), per)
    found = []
    for at, hashes in [(slice(None), w.hashes), *w.prefixes]:
        feature, of = hashes >> np.uint64(64 - BITS), text[at]
        if weights is not None:
            on = np.flatnonzero(weights[feature])
            feature, of = feature[on], of[on]
        found.append((of << np.uint64(BITS)) | feature)
    pairs, count = np.unique(np.concatenate(found), return_counts=True)
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64), count, per


def _values(text: np.ndarray, count: np.ndarray, per: np.ndarray) -> np.ndarray:
    return np.log1p(1000.0 * count / (per[text] + 50.0))


def _drawn(labels: DataFrame, params: Fit) -> tuple[DataFrame, list[float]]:
    """(doc_id, toxic) of the sample, at most params.sample_rows rows, and what a document of either label counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic").cast("int") > 0, 1).otherwise(0)).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = params.sample_rows // 2
    take = [min(n.get(k, 0), max(half, params.sample_rows - n.get(1 - k, 0))) for k in (0, 1)]
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take[k]) for k in (0, 1)]
    counts = [n.get(k, 0) / max(1, take[k]) for k in (0, 1)]
    mean = max(1, sum(n.values())) / max(1, sum(take))
    return parts[0].unionByName(parts[1]), [c / mean for c in counts]


def fit(docs: DataFrame, labels: DataFrame, params: Fit | None = None) -> Model:
    """Learns from docs joined with labels (doc_id, toxic). Rows with a null id, label or text are not used; of rows with
    the same id one text is.

    Without any usable labelled row, or with one class only, the model has no weights and calls nothing toxic.
    """
    params = params or Fit()
    chosen, weigh = _drawn(labels, params)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows short rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column("toxic").to_numpy(zero_copy_only=False)
            for c in T.chunks(b.column("text")):
                text, feature, count, per = _feature_counts(c)
                cut = np.searchsorted(text, np.arange(len(per) + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(c.first, len(per)), pa.array(label[c.first : c.first + len(per)].astype(np.int32)), pa.array(per.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(count.astype(np.int32)))],
                    names=["doc_id", "toxic", "words", "feature", "count"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    sample = saved(rows.mapInArrow(lean(features), f"doc_id {key}, toxic int, words long, feature array<int>, count array<int>"))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.arange(params.grades - 1) + 10.0)
    used = _used(sample, n[1], n[0], params)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[used[0]] = True
        for b in batches:
            lists = b.column("feature")
            feature, count = lists.flatten().to_numpy(), b.column("count").flatten().to_numpy()
            on = wanted[feature]
            ends = np.concatenate(([0], np.cumsum(on)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("words"), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature[on])), pa.ListArray.from_arrays(pa.array(ends), pa.array(count[on]))], names=b.schema.names)

    got = sample.mapInArrow(lean(kept), sample.schema).toArrow().combine_chunks()  # at most sample_rows rows, of chosen features only
    order = np.argsort(np.array([str(x) for x in got["doc_id"].to_pylist()]))  # the same sums whatever the order of the rows
    got = got.take(pa.array(order))
    lists = got["feature"].combine_chunks() if isinstance(got["feature"], pa.ChunkedArray) else got["feature"]
    text = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()))
    count = got["count"].combine_chunks().flatten().to_numpy()
    return train(got["toxic"].to_numpy().astype(bool), text, lists.flatten().to_numpy().astype(np.int64), count, got["words"].to_numpy(), params, *used[1:], np.array(weigh))


def _used(sample: DataFrame, n1: int, n0: int, params: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids from the sample's counts, sorted: those used at all, those with a weight, those of the lexicon.

    A weight have the params.features features whose share of toxic documents is farthest from the sample's, over three
    standard deviations. The lexicon has those that are much more frequent in toxic documents.
    """
    share = n1 / (n1 + n0)
    per = sample.select(F.explode("feature").alias("feature"), "toxic").groupBy("feature").agg(F.sum("toxic").alias("in1"), F.count(F.lit(1)).alias("df"))
    far = F.abs(F.col("in1") - share * F.col("df")) / F.sqrt(share * (1 - share) * F.col("df"))
    scored = per.where(F.col("df") >= params.min_docs).select(
        "feature", far.alias("far"), ((F.col("in1") >= params.min_docs) & (F.col("in1") / n1 >= params.lexicon_ratio * (F.col("df") - F.col("in1") + 0.5) / n0)).alias("lexicon")
    )
    best = scored.where("far > 3").orderBy(F.desc("far"), "feature").limit(params.features).select("feature")
    weighted = np.sort(np.array([r["feature"] for r in best.collect()], np.int64))
    lexicon = np.sort(np.array([r["feature"] for r in scored.where("lexicon").select("feature").collect()], np.int64))  # at most 2 ** BITS ids
    return np.union1d(weighted, lexicon), weighted, lexicon


def derive_grades(toxic: np.ndarray, text: np.ndarray, in_lexicon: np.ndarray, count: np.ndarray, per: np.ndarray, params: Fit) -> np.ndarray:
    """Grades 0 to grades - 1 from yes/no labels; see the module's text."""
    density = np.bincount(text, weights=count * in_lexicon, minlength=len(toxic)) / np.maximum(per, 1)
    grade = np.zeros(len(toxic), np.int64)
    if toxic.any():
        edges = np.quantile(density[toxic], np.arange(1, params.grades - 1) / (params.grades - 1))
        grade[toxic] = 1 + np.searchsorted(edges, density[toxic], "left")
    return grade


def negative_log_likelihood(weights: np.ndarray, theta: np.ndarray, x: np.ndarray, grade: np.ndarray, counts: np.ndarray) -> float:
    """The mean of -log P(grade | x), each document counting counts; what train() makes small. x: a row for each document."""
    below = np.hstack([np.zeros((len(x), 1)), _sigmoid(theta[None, :] - (x @ weights)[:, None]), np.ones((len(x), 1))])
    p = np.diff(below, axis=1)[np.arange(len(x)), grade]
    return float(-(counts * np.log(np.maximum(p, 1e-9))).mean())


def train(toxic: np.ndarray, text: np.ndarray, feature: np.ndarray, count: np.ndarray, per: np.ndarray, params: Fit, weighted: np.ndarray, lexicon: np.ndarray, weigh: np.ndarray) -> Model:
    """The model from (text, feature, count) of documents with labels toxic and numbers of words per; weigh: what a document of either label counts."""
    grade = derive_grades(toxic, text, np.isin(feature, lexicon), count, per, params)
    counts = weigh[toxic.astype(int)]
    keep = np.isin(feature, weighted)
    value = _values(text, count, per)[keep]
    text, feature = text[keep], feature[keep]
    ids, at = np.unique(feature, return_inverse=True)
    n, k = len(toxic), params.grades
    share = np.cumsum(np.bincount(grade, weights=counts, minlength=k))[:-1] / n
    share = np.clip(share, 1e-6, 1 - 1e-6)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(k - 1))
    rows = np.arange(n)

    def slope(w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of negative_log_likelihood()."""
        s = np.bincount(text, weights=w[at] * value, minlength=n)
        upper = np.hstack([_sigmoid(theta[None, :] - s[:, None]), np.ones((n, 1))])
        lower = np.hstack([np.zeros((n, 1)), upper[:, :-1]])
        p = np.maximum(upper[rows, grade] - lower[rows, grade], 1e-9) / counts
        du, dl = (upper * (1 - upper))[rows, grade] / p, (lower * (1 - lower))[rows, grade] / p
        by_theta = np.bincount(grade, weights=-du, minlength=k)[: k - 1] + np.bincount(grade, weights=dl, minlength=k)[1:]
        return np.bincount(at, weights=(du - dl)[text] * value, minlength=len(ids)) / n, by_theta / n

    # Accelerated proximal gradient steps; the step is one over the largest curvature.
    v = np.ones(len(ids))
    for _ in range(20):
        v /= np.linalg.norm(v) or 1.0
        v = np.bincount(at, weights=np.bincount(text, weights=v[at] * value, minlength=n)[text] * value, minlength=len(ids)) / n
    step = 2.0 / ((np.linalg.norm(v) + 1.0) * max(1.0, counts.max()))
    w, last_w, t = np.zeros(len(ids)), np.zeros(len(ids)), 1.0
    for _ in range(params.steps):
        t, t_before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = w + (t_before - 1) / t * (w - last_w)
        by_w, by_theta = slope(ahead, theta)
        last_w, w = w, ahead - step * by_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * params.l1, 0)
        theta = np.maximum.accumulate(theta - step * by_theta + 1e-6 * np.arange(k - 1))
    on = w != 0
    model = Model(ids[on], w[on].astype(np.float32), theta)
    chance = 1 - model.probabilities(np.bincount(text, weights=w[at] * value, minlength=n))[:, 0]
    model.reject = rejection(chance, toxic, counts)
    return model


def rejection(chance: np.ndarray, toxic: np.ndarray, counts: np.ndarray, clean_counts: float = 2.0) -> float:
    """The level that costs least on the sample, a clean document rejected counting clean_counts times a toxic one kept."""
    odds = np.linspace(-4, 1, 101)
    levels = 1 / (1 + np.exp(-odds))
    cost = np.array([clean_counts * counts[~toxic & (chance >= v)].sum() + counts[toxic & (chance < v)].sum() for v in levels])
    best = np.flatnonzero(cost == cost.min())
    return float(levels[best[len(best) // 2]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _p_toxic, _severity (both double) and _grade (int). Null and empty texts score as texts without words.

    Columns of docs with these names give way. Repeated rows score alike; an empty table gives no rows.
    """
    docs = without(docs, "_p_toxic", "_severity", "_grade")
    bundle = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.thresholds))  # bounded by 2 ** BITS weights
    import pyspark.sql.types as S

    schema = S.StructType([*docs.schema.fields, S.StructField("_p_toxic", S.DoubleType()), S.StructField("_severity", S.DoubleType()), S.StructField("_grade", S.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*bundle.value)  # scores do not need the level
        table = m.table()
        for b in batches:
            s = np.zeros(b.num_rows)
            for c in T.chunks(b.column("text")):
                text, feature, count, per = _feature_counts(c, table)
                s[c.first : c.first + len(per)] = np.bincount(text, weights=table[feature] * _values(text, count, per), minlength=len(per))
            p = m.probabilities(s)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(1 - p[:, 0]), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1).astype(np.int32))],
                names=[*b.schema.names, "_p_toxic", "_severity", "_grade"],
            )

    return docs.mapInArrow(lean(run), schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, params: Fit | None = None, reject: float | None = None) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) for each row of docs; toxic: P(grade >= 1) is at least reject, or the model's own level.

    Null and empty texts have no words and are as a text of none; ids may be null or repeated.
    """
    model = fit(docs, labels, params)
    reject = model.reject if reject is None else reject
    out = score(docs.select("doc_id", "text"), model).drop("text")
    return out.select("doc_id", F.round("_severity", 9).alias("severity"), F.col("_grade").alias("grade"), F.round("_p_toxic", 9).alias("p_toxic"), (F.col("_p_toxic") >= reject).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: Fit | None = None, reject: float | None = None) -> DataFrame:
    """The rows of docs that are not toxic, all columns as they were."""
    model = fit(docs, labels, params)
    out = score(set_aside(docs), model).where(F.col("_p_toxic") < (model.reject if reject is None else reject))
    return put_back(out, docs.columns)
