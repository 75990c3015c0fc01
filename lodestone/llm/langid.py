"""Language of a text by a bidirectional gated recurrent network over its bytes.

Two gated recurrent units read a window of bytes, one from each side. At every position both states together give the
probabilities of the languages; a document's probabilities are the mean over all its positions. The network is trained
here in numpy, by backpropagation through time, on windows of a bounded sample of labelled documents: at every position
it is to name the document's language. Whole texts are labelled: each is cut into windows, and thousands of windows
of a batch move in step, so that a step is a few products of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as S
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textarrays as T
from lodestone.llm.common import crc_of_id, without

#: Bytes of a window when texts are labelled, and windows that move in step.
WINDOW, STEPPED = 128, 1024


@dataclass
class Fit:
    """per_lang: documents of a language learned from, about, drawn by a hash of id and text; windows: windows of each.

    Every language is learned: the sample is bounded by languages * per_lang documents of at most windows * length bytes.
    A row that is repeated, as often as it may be, is learned from once.
    """

    per_lang: int = 300
    windows: int = 6
    length: int = 48
    hidden: int = 12
    steps: int = 450
    batch: int = 192
    rate: float = 0.02
    seed: int = 11


_INPUT = np.arange(256)
_INPUT[65:91] += 32  # A-Z are read as a-z


class Network:
    """Parameters: for each direction and gate (keep, reset, new) a row for each byte and a square matrix; one output layer."""

    def __init__(self, langs: list[str], hidden: int, rng: np.random.Generator | None = None) -> None:
        self.langs, self.hidden = langs, hidden
        rng = rng or np.random.default_rng(0)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            for g in "zrn":
                self.p[f"W{d}{g}"] = draw(256, hidden)
                self.p[f"U{d}{g}"] = draw(hidden, hidden)
            self.p[f"W{d}z"] += 1.0
        self.p["Vf"], self.p["Vb"], self.p["c"] = draw(hidden, len(langs)), draw(hidden, len(langs)), np.zeros(len(langs), np.float32)

    def _read(self, x: np.ndarray, d: str, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """The states of one direction over x (length, windows): (position, state). The state is reused in the next step."""
        w, u = [self.p[f"W{d}{g}"] for g in "zrn"], [self.p[f"U{d}{g}"] for g in "zrn"]
        # sigmoid(a) is 0.5 + 0.5 * tanh(a / 2)
        w[0], w[1], u[0], u[1] = w[0] * 0.5, w[1] * 0.5, u[0] * 0.5, u[1] * 0.5
        n, h = x.shape[1], np.zeros((x.shape[1], self.hidden), np.float32)
        z, r, a, t = (np.empty((n, self.hidden), np.float32) for _ in range(4))
        for at in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            for gate, k in ((z, 0), (r, 1)):
                np.dot(h, u[k], out=gate)
                np.take(w[k], x[at], axis=0, out=t)
                gate += t
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            np.dot(h, u[2], out=a)
            if keep is not None:
                keep.append((h.copy(), z.copy(), r.copy(), a.copy()))
            a *= r
            np.take(w[2], x[at], axis=0, out=t)
            a += t
            np.tanh(a, out=a)
            if keep is not None:
                keep[-1] += (a.copy(),)
            h -= a
            h *= z
            h += a
            yield at, h

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(length, windows, languages) for bytes x (length, windows)."""
        x = _INPUT[x]
        out = np.empty((*x.shape, len(self.langs)), np.float32)
        for at, h in self._read(x, "f"):
            np.dot(h, self.p["Vf"], out=out[at])
        for at, h in self._read(x, "b"):
            out[at] += h @ self.p["Vb"]
        out += self.p["c"]
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, there: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, or those there; x (length, windows) bytes, y (windows) language numbers."""
        x = _INPUT[x]
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: np.empty((*x.shape, self.hidden), np.float32) for d in "fb"}
        for d in "fb":
            for at, h in self._read(x, d, kept[d]):
                states[d][at] = h
        logits = states["f"] @ self.p["Vf"] + states["b"] @ self.p["Vb"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        prob[:, np.arange(len(y)), y] -= 1
        prob /= x.size if there is None else max(1, there.sum())
        if there is not None:
            prob *= there[:, :, None]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"] = prob.sum(axis=(0, 1))
        for d in "fb":
            g[f"V{d}"] = np.tensordot(states[d], prob, ([0, 1], [0, 1]))
            from_out = prob @ self.p[f"V{d}"].T
            order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
            steps = list(zip(order, kept[d], strict=True))
            back = np.zeros((x.shape[1], self.hidden), np.float32)
            inputs: dict[str, list] = {k: [] for k in "zrn"}
            for at, (h, z, r, a, new) in reversed(steps):
                back = back + from_out[at]
                d_new = back * (1 - z) * (1 - new * new)
                d_z = back * (h - new) * z * (1 - z)
                d_r = d_new * a * r * (1 - r)
                d_a = d_new * r
                back = back * z + d_z @ self.p[f"U{d}z"].T + d_r @ self.p[f"U{d}r"].T + d_a @ self.p[f"U{d}n"].T
                for k, v in (("z", d_z), ("r", d_r), ("n", d_a)):
                    g[f"U{d}{k}"] += h.T @ v
                for k, v in (("z", d_z), ("r", d_r), ("n", d_new)):
                    inputs[k].append(v)
            bytes_of = np.concatenate([x[at] for at, _ in reversed(steps)])
            one_hot = np.zeros((len(bytes_of), 256), np.float32)
            one_hot[np.arange(len(bytes_of)), bytes_of] = 1
            for k in "zrn":
                g[f"W{d}{k}"] = one_hot.T @ np.concatenate(inputs[k])
        return g


def train(windows: np.ndarray, lang: np.ndarray, langs: list[str], params: Fit) -> Network:
    """windows (n, length) bytes, lang (n) numbers of langs; every language has the same share of a batch."""
    rng = np.random.default_rng(params.seed)
    net = Network(langs, params.hidden, rng)
    if len(langs) < 2:
        return net
    rows = [np.flatnonzero(lang == k) for k in range(len(langs))]
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, params.steps + 1):
        pick = np.concatenate([r[rng.integers(0, len(r), -(-params.batch // len(langs)))] for r in rows])
        # Every other window is cut short: short texts, and the ends of long ones, look so.
        cut = np.where(np.arange(len(pick)) % 2, rng.integers(4, windows.shape[1] + 1, len(pick)), windows.shape[1])
        there = np.arange(windows.shape[1])[:, None] < cut
        g = net.gradients(np.where(there, windows[pick].T, np.uint8(0)), lang[pick], there)
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = params.rate * min(1.0, 2.0 * (1 - step / (params.steps + 1)))
        for k, v in g.items():
            v = v / max(1.0, size)
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            net.p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _even_windows(data: bytes, n: int, length: int) -> Iterator[bytes]:
    """n windows spread evenly over the text; one padded with zeros if the text is shorter."""
    if len(data) <= length:
        yield data.ljust(length, b"\0")
        return
    for at in np.unique(np.linspace(0, len(data) - length, n).astype(np.int64)).tolist():
        yield data[at : at + length]


def fit(labelled: DataFrame, params: Fit | None = None) -> Network:
    """Learns from labelled (doc_id, text, lang); rows without text or lang are not used.

    With one language only it is always predicted; without any the network has none.
    """
    params = params or Fit()
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Network([], params.hidden)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(params.per_lang / r["n"]))])
    place = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0
    drawn = usable.where(F.col("lang").isin(langs)).where(place < F.element_at(share, F.col("lang")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, w, i) for lang, text, i in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "doc_id")), strict=True) for w in _even_windows(text.encode(), params.windows, params.length)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "window", "doc_id"])

    got = drawn.select("lang", "text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(cut, "lang string, window binary, doc_id long").distinct().toArrow()  # about per_lang * windows short rows a language
    rows = sorted(zip(*(got[c].to_pylist() for c in ("lang", "window", "doc_id")), strict=True), key=lambda r: (r[0], r[2] or 0, r[1]))
    number = {lang: k for k, lang in enumerate(sorted({r[0] for r in rows}))}
    windows = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, params.length)
    return train(windows, np.array([number[r[0]] for r in rows], np.int64), list(number), params)


def _pooled(net: Network, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """For each text of the chunk the summed probabilities and the positions labelled with each language."""
    size = np.diff(chunk.offsets)
    n_texts, n_langs = len(size), len(net.langs)
    sums, votes = np.zeros((n_texts, n_langs)), np.zeros((n_texts, n_langs), np.int64)
    per = -(-size // WINDOW)
    text = np.repeat(np.arange(n_texts), per)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = chunk.offsets[:-1][text] + inner * WINDOW
    length = np.minimum(WINDOW, chunk.offsets[1:][text] - begin)
    padded = np.concatenate((chunk.data, np.zeros(WINDOW, np.uint8)))
    order = np.argsort(length, kind="stable")  # windows of about the same length move together
    stepped = max(1, STEPPED * 64 // max(64, n_langs))  # of many languages fewer at once: the memory stays the same
    for i in range(0, len(order), stepped):
        part = order[i : i + stepped]
        steps = np.arange(int(length[part].max()))[:, None]
        x = padded[np.minimum(begin[part] + steps, len(padded) - 1)]
        there = steps < length[part]
        x = np.where(there, x, np.uint8(0))
        p = net.probabilities(x)
        p *= there[:, :, None]
        best = p.argmax(axis=2)
        for k in range(n_langs):
            np.add.at(sums[:, k], text[part], p[:, :, k].sum(axis=0))
            np.add.at(votes[:, k], text[part], ((best == k) & there).sum(axis=0))
    return sums, votes


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """docs with _lang, _score (mean probability of that language) and _share (of positions labelled so).

    Columns of docs with these names give way. Repeated rows are labelled alike; an empty table gives no rows.
    Texts that are null or have no letter are `und` with score 0, as are all where the network knows no language.
    """
    docs = without(docs, "_lang", "_score", "_share")
    model = docs.sparkSession.sparkContext.broadcast((net.langs, net.hidden, net.p))  # a few kilobytes a language
    schema = S.StructType([*docs.schema.fields, S.StructField("_lang", S.StringType()), S.StructField("_score", S.DoubleType()), S.StructField("_share", S.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, hidden, p = model.value
        own = Network(langs, hidden)
        own.p = p
        for b in batches:
            best, score, share = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.zeros(b.num_rows)
            if langs:
                for c in T.chunks(b.column("text")):
                    sums, votes = _pooled(own, c)
                    at = slice(c.first, c.first + len(sums))
                    positions = np.maximum(np.diff(c.offsets), 1)
                    best[at] = sums.argmax(axis=1)
                    score[at] = np.clip(sums.max(axis=1) / positions, 0, 1)
                    share[at] = votes[np.arange(len(votes)), best[at]] / positions
            names = pa.array([langs[k] if k >= 0 else None for k in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, names, pa.array(score), pa.array(share)], names=[*b.schema.names, "_lang", "_score", "_share"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.col("_lang").isNotNull()
    out = docs.mapInArrow(run, schema)
    return out.withColumns({"_lang": F.when(letters, F.col("_lang")).otherwise("und"), "_score": F.when(letters, F.col("_score")).otherwise(0.0), "_share": F.when(letters, F.col("_share")).otherwise(0.0)})


def train_rows(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 3 != 1


def lang_report(docs: DataFrame, params: Fit | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, share) for each row of docs; learns from rows whose crc32(doc_id) mod 3 is not 1.

    Texts that are null or have no letter are `und`; ids may be null or repeated, each row has its own prediction.
    """
    net = fit(docs.where(train_rows(F.col("doc_id"))).select("doc_id", "text", "lang"), params)
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (~train_rows(F.col("doc_id"))).alias("held_out"), F.col("_lang").alias("lang_pred"), F.round("_score", 6).alias("score"), F.round("_share", 6).alias("share"))
