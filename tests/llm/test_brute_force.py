"""Operators that SQL cannot say, against plain versions that share no code with them."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, kdshards, langid, mjpeg, neardup, ngram_lm, toxicity, urlfilter
from lodestone.llm.common import table
from tests.conftest import ROOT, SF

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


@pytest.fixture(scope="module")
def tables(spark):
    return {n: table(spark, SF, n) for n in ("documents", "labels", "pages", "benchmark")}


@pytest.fixture(scope="module")
def rows(tables):
    return tables["documents"].collect()


def test_language_model_token_by_token(tables, rows):
    """The model anew with dictionaries: counts of all training texts, weights by expectation-maximisation on the deleted ones."""
    got = {r.doc_id: r for r in ngram_lm.lm_report(tables["documents"]).collect()}
    texts = {r.doc_id: [*words(r.text), "</s>"] for r in rows}
    train = [d for d in texts if crc(d) % 5 != 1]
    deleted = {d for d in train if crc(d) % ngram_lm.DELETED == 2}

    def counts(ids):
        one, two = Counter(), Counter()
        for d in ids:
            one.update(texts[d])
            two.update(zip(["<s>", *texts[d][:-1]], texts[d], strict=True))
        return one, two, len(ids)

    def estimates(d, one, two, n_texts):
        n, uniform = sum(one.values()), 1 / (len(one) + 1)
        for before, w in zip(["<s>", *texts[d][:-1]], texts[d], strict=True):
            seen = n_texts if before == "<s>" else one[before]
            bucket = min(ngram_lm.BUCKETS - 1, 1 + int(math.log2(seen))) if seen else 0
            yield bucket, (two[before, w] / seen if seen else 0.0, one[w] / n, uniform)

    rest = counts([d for d in train if d not in deleted])
    held = Counter()
    for d in deleted:
        for bucket, p in estimates(d, *rest):
            held[bucket, *(2.0 ** (-min(159, round(-math.log2(x) * 4)) / 4) if x else 0.0 for x in p[:2]), p[2]] += 1
    mix = defaultdict(lambda: [1 / 3] * 3)
    for _ in range(60):
        share = defaultdict(lambda: [0.0] * 3)
        for (bucket, *p), n in held.items():
            parts = [m * x for m, x in zip(mix[bucket], p, strict=True)]
            for k in range(3):
                share[bucket][k] += n * parts[k] / sum(parts)
        for bucket, s in share.items():
            s = [s[0], *(max(x, 1e-6 * max(sum(s), 1)) for x in s[1:])]
            mix[bucket] = [x / sum(s) for x in s]
    everything = counts(train)
    one, n, v = everything[0], sum(everything[0].values()), len(everything[0])
    for d, tokens in texts.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d not in train, len(tokens), sum(one[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((one[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel_tol=1e-9)
        want = sum(math.log10(sum(m * x for m, x in zip(mix[b], p, strict=True))) for b, p in estimates(d, *everything))
        assert math.isclose(r.score, want, rel_tol=2e-3)


def test_language_network_one_position_at_a_time():
    """Two gated recurrent units by plain loops, each over one window."""
    rng = np.random.default_rng(4)
    net = langid.Network(["a", "b", "c"], 5, rng)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    text = "Eine KLEINE Probe, été.".encode()
    data = np.frombuffer(text.lower(), np.uint8)

    def states(order, d):
        h, out = np.zeros(5), {}
        for i in order:
            x = data[i]
            z = sigmoid(net.p[f"W{d}z"][x] + h @ net.p[f"U{d}z"])
            r = sigmoid(net.p[f"W{d}r"][x] + h @ net.p[f"U{d}r"])
            n = np.tanh(net.p[f"W{d}n"][x] + r * (h @ net.p[f"U{d}n"]))
            h = z * h + (1 - z) * n
            out[i] = h
        return out

    forth, back = states(range(len(data)), "f"), states(reversed(range(len(data))), "b")
    want = []
    for i in range(len(data)):
        v = forth[i] @ net.p["Vf"] + back[i] @ net.p["Vb"] + net.p["c"]
        want.append(np.exp(v - v.max()) / np.exp(v - v.max()).sum())
    got = net.probabilities(np.frombuffer(text, np.uint8)[:, None])[:, 0, :]
    assert np.abs(got - np.array(want)).max() < 1e-5


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = langid.lang_report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    assert out.selectExpr("avg(cast(lang = lang_pred AS int)) AS right").first().right >= 0.98


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_keep_equal_texts_together(spark, shards):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = kdshards.shard_report(docs, shards).withColumnRenamed("size", "bytes").join(docs.selectExpr("doc_id", "coalesce(text, '') AS text"), "doc_id").collect()
    target = sum(r.bytes for r in rows) / shards
    held, groups = Counter(), defaultdict(set)
    for r in rows:
        assert (r.bytes, r.text_crc32) == (len(r.text.encode()) + 16, zlib.crc32(r.text.encode()))
        held[r.shard] += r.bytes
        groups[r.text].add(r.shard)
    weight = Counter()
    for r in rows:
        weight[r.text] += r.bytes
    assert all(len(g) == 1 or weight[t] > target for t, g in groups.items())
    assert len(held) == shards and max(abs(b - target) for b in held.values()) <= max(weight.values())
    for s in held:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_a_group_larger_than_a_shard_is_told_apart_by_id(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id < 1000 THEN 'copy of one text' ELSE concat('text number ', id) END AS text")
    rows = kdshards.sharded(docs.selectExpr("*", "'x' AS _shard"), 10).select("doc_id", "text", "_shard").collect()
    held = Counter(r._shard for r in rows)
    assert len(rows) == 3000 and max(held.values()) < 1.2 * 300 and len({r._shard for r in rows if r.doc_id < 1000}) > 1


def test_leaks_by_sets(tables, rows):
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_common) for r in decontam.leaks(tables["documents"], tables["benchmark"]).collect()}
    texts = {r.doc_id: (words(r.text), shingles(r.text)) for r in rows}
    want = {}
    for item in tables["benchmark"].collect():
        w, own = words(item.text), shingles(item.text)
        for d, (all_of, sets) in texts.items():
            inside = sets if len(w) >= 5 else {tuple(all_of[i : i + len(w)]) for i in range(len(all_of) - len(w) + 1)}
            if own and len(own & inside) >= 0.75 * len(own):
                want[d, item.item_id] = (len(own), len(own & inside))
    assert got == want and len(got) >= 3


def test_leaks_in_many_blocks(tables, monkeypatch):
    docs, items = tables["documents"], tables["benchmark"]
    whole = sorted(decontam.leaks(docs, items).collect())
    kept = sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 800)
    assert sorted(decontam.leaks(docs, items.union(items)).collect()) == whole
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == kept
    with pytest.raises(ValueError):
        decontam.leaks(docs, items, threshold=0.5)


def test_near_duplicates_by_sets(tables, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_dup_report(tables["documents"]).collect()}
    sets, root = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}
    for a in sorted(sets):
        for b in sets:
            if b > a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert got == {d: (len(s), root[d]) for d, s in sets.items()}
    with pytest.raises(ValueError):
        neardup.near_duplicates(tables["documents"], threshold=0.6)


def test_near_duplicates_of_ids_that_repeat(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:58], "x", "y"]
    rows = [(1, "one text of its own here"), (1, " ".join(base)), (2, " ".join(near)), (3, "another text that is like nothing"), *[(4, f"text {i} under one id and {i}") for i in range(3000)], (5, "text 7 under one id and 7"), *[(6, " ".join(base))] * 2000, (None, " ".join(base))]
    got = {r.doc_id: r.component_id for r in neardup.near_dup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 1, None: None}


def plain_trees(table, params):
    """Boosted trees by the same loss, in plain loops over rows: (margins of the rows)."""
    y = [r["y"] for r in table]
    n, total = len(y), sum(y)
    xs = [[r[f"x{i}"] for i in range(urlfilter.N_FEATURES)] for r in table]
    edges = []
    for i in range(urlfilter.N_FEATURES):
        v = sorted(x[i] for x in xs)
        edges.append(sorted({v[max(0, math.ceil(k / params.bins * n) - 1)] for k in range(1, params.bins)}))
    bins = [[sum(x[i] > e for e in edges[i]) for i in range(urlfilter.N_FEATURES)] for x in xs]
    margin = [math.log(total / (n - total))] * n
    for _ in range(params.trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]
        nodes, leaves = {1: list(range(n))}, []
        for level in range(params.depth):
            for node in [k for k in nodes if 1 << level <= k < 2 << level]:
                rows, best, most = nodes[node], None, 1e-3
                score = lambda r: sum(g[i] for i in r) ** 2 / (sum(h[i] for i in r) + params.leaf)
                for f in range(urlfilter.N_FEATURES):
                    for b in sorted({bins[i][f] for i in rows})[:-1]:
                        low, high = [i for i in rows if bins[i][f] <= b], [i for i in rows if bins[i][f] > b]
                        gain = score(low) + score(high) - score(rows)
                        if min(sum(h[i] for i in low), sum(h[i] for i in high)) >= 0.5 and gain > most + 1e-9:
                            best, most = (low, high), gain
                if best:
                    del nodes[node]
                    nodes[2 * node], nodes[2 * node + 1] = best
                    leaves += [2 * node, 2 * node + 1]
        if not leaves:
            break
        for node, rows in nodes.items():
            for i in rows:
                margin[i] += params.rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + params.leaf)
    return margin


def test_boosted_trees_by_loops(spark):
    rng = np.random.default_rng(9)
    params = urlfilter.Fit(trees=4, depth=2, bins=8)
    rows = []
    for _ in range(160):
        x = [float(v) for v in rng.integers(0, 12, urlfilter.N_FEATURES)]
        rows.append((int(x[2] + rng.normal(0, 2) > 6 or x[5] > 10), *x))
    names = [f"x{i}" for i in range(urlfilter.N_FEATURES)]
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"{c} double" for c in names))
    trees = urlfilter.boost(df, params)
    got = [r.m for r in df.coalesce(1).select(urlfilter.margin(trees, lambda i: F.col(f"x{i}")).alias("m")).collect()]
    assert np.allclose(got, plain_trees([r.asDict() for r in df.coalesce(1).collect()], params), atol=1e-9)
    assert 4 == len(trees.trees) and len(set(np.round(got, 6))) > 4


def plain_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return rest[:end].translate(LOW), path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def test_url_rules_and_what_the_trees_say_elsewhere(spark):
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    verdicts = Counter()
    for r in urlfilter.url_report(pages).collect():
        host, path = plain_host(urls[r.page_id])
        fits = [(len(h + p), h + p, say) for say, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert not fits or r.verdict == max(fits)[2]
        verdicts[r.verdict, bool(fits)] += 1
    assert min(verdicts[v, False] for v in ("allow", "block")) > 100


def test_entropy_of_a_long_host(spark):
    host = "".join(chr(97 + i % 26) for i in range(700)) + "é" * 300
    got = spark.createDataFrame([(host,)], "h string").select(urlfilter.entropy(F.col("h")).alias("e")).first().e
    assert math.isclose(got, -sum(n / 1000 * math.log2(n / 1000) for n in Counter(host).values()), rel_tol=1e-9)


def test_one_url_with_most_rows_is_learned_from_once(spark):
    rows = [(i, "http://a.net/es/hot") for i in range(3000)] + [(i, f"http://h{i % 7}.com/p{i}") for i in range(3000, 3200)]
    labelled = spark.createDataFrame(rows, "page_id long, url string")
    few = labelled.select("url", urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"), F.col("url").contains(".net").cast("int").alias("y"))
    _, stats, _ = urlfilter.learn(few, urlfilter.Fit(trees=1))
    assert stats.where("kind = 'head' and key = 'es'").count() <= 1 and stats.where("key in ('net', 'com')").count() == 0


def test_toxicity_likelihood(tables):
    """train() ends where no small step in any direction makes the likelihood, penalty included, better by much."""
    rng = np.random.default_rng(1)
    params = toxicity.Fit(steps=10000, features=40)
    n, k = 300, 12
    toxic = rng.random(n) < 0.3
    count = rng.poisson(1 + 2 * toxic[:, None] * (np.arange(k) < 4), (n, k))
    per = np.full(n, 60)
    text, feature = np.nonzero(count)
    lexicon, weigh = np.arange(4), np.array([0.8, 1.4])
    model = toxicity.train(toxic, text, feature, count[text, feature], per, params, np.arange(k), lexicon, weigh)
    x = np.log1p(1000 * count / 110)
    grade = toxicity.derive_grades(toxic, text, np.isin(feature, lexicon), count[text, feature], per, params)
    w = np.zeros(k)
    w[model.features] = model.weights
    cost = lambda w, theta: toxicity.negative_log_likelihood(w, theta, x, grade, weigh[toxic.astype(int)]) + params.l1 * np.abs(w).sum()
    least = cost(w, model.thresholds)
    for i in range(k + len(model.thresholds)):
        for step in (-0.02, 0.02):
            v, theta = w.copy(), model.thresholds.copy()
            (v if i < k else theta)[i % k if i < k else i - k] += step
            assert cost(v, theta) > least - 1e-3
    below = 1 / (1 + np.exp(-(model.thresholds[None, :] - (x @ w)[:, None])))
    want = np.diff(np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))]), axis=1)
    assert np.allclose(model.probabilities(x @ w), want) and set(grade) == {0, 1, 2, 3}


def test_toxicity_of_rare_and_repeated_labels(spark):
    rows = [(i, f"plain words number{i % 50} and more of them here {'vilest hateful' * (i % 100 == 0)}") for i in range(3000)] + [(5, "plain words again")] * 10000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(3000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, toxicity.Fit(sample_rows=200))
    out = toxicity.score(docs.where("doc_id <> 5"), model).select("doc_id", (F.col("_p_toxic") >= model.reject).alias("t")).collect()
    assert all(r.t == (r.doc_id % 100 == 0) for r in out)


def test_media_files_and_features(tables, rows):
    """The stored file anew from its parts, and shots from the histograms of plain frames."""
    files = {r.id: r.media for r in mjpeg.as_media(tables["documents"]).collect()}
    for r in mjpeg.media_report(tables["documents"]).collect():
        file = files[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert file[:4] == b"RIFF" and int.from_bytes(file[4:8], "little") == len(file) - 8 and file[8:12] == b"AVI "
        text = next((x.text or "").encode() for x in rows if x.doc_id == r.doc_id)
        frames = max(1, -(-len(text) // mjpeg.FRAME))
        pixels = np.frombuffer(text.ljust(frames * mjpeg.FRAME, b"\0"), np.uint8).reshape(frames, -1)
        assert r.feature.startswith(f"frames={frames};") and f";luma={pixels.mean(dtype=np.float64):.3f};" in r.feature
        clips = [tuple(map(float, c.split("-"))) for c in r.feature.partition("clips=")[2].split(",")]
        assert clips[0][0] == 0 and all(a[1] == b[0] for a, b in zip(clips, clips[1:], strict=False)) and f";shots={len(clips)};" in r.feature


def test_media_of_a_long_text_in_parts(spark, monkeypatch):
    text = "".join(f"{i} " for i in range(30000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").coalesce(1)
    whole = {r.id: r.media for r in mjpeg.as_media(docs).collect()}
    monkeypatch.setattr(mjpeg, "GROUP", 3)
    assert mjpeg.load(mjpeg.store(next(mjpeg.T.chunks(__import__("pyarrow").array([text])))))[0][0].rstrip(b"\0") == text.encode()
    assert mjpeg.store(next(mjpeg.T.chunks(__import__("pyarrow").array([text]))))[0] == whole[1]


def test_columns_that_clash_give_way(spark):
    own = "_lang _score _share _ids _decoded _shard _p_toxic _severity _grade _rest _size _h".split()
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string").selectExpr("*", *[f"7 AS {c}" for c in own])
    path, pattern = __import__("public_tokenizers").path("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN
    results = [langid.identify(docs, langid.Network(["a", "b"], 4)), bpe.encode(docs, path, pattern), bpe.decode(bpe.encode(docs, path, pattern), path, pattern), kdshards.sharded(docs, 2)]
    results += [toxicity.score(docs, toxicity.Model(np.zeros(0, np.int64), np.zeros(0), np.arange(3.0)))]
    urls = docs.selectExpr("*", "'http://a.net/es/x' AS url", *[f"8 AS {c}" for c in ("_host", "_path", "_rule", "_verdict", "_p_block", "host", "path", "say")])
    results += [urlfilter.judged(urls)]
    for df in results:
        assert len(df.columns) == len(set(df.columns)) and df.count() == 1 and df.first().doc_id == 1
    assert results[-1].first()._verdict == "block" and results[-1].first().host == 8


def test_entry_without_the_vocabulary_files():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'pipeline' in e.queries() and 'op6_bpe_codec' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ)


def test_pipeline_end_to_end(spark, tables, rows):
    """Each stage's rows from the rows before it, by plain code; the first stage by what its operator scores."""
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    toxic = {r.doc_id for r in toxicity.toxicity_report(tables["documents"], tables["labels"]).where("toxic").collect()}
    texts = {r.doc_id: r.text for r in rows if r.doc_id not in toxic}
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOW)
    first = {}
    for d in sorted(texts):
        for line in (texts[d] or "").split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), d)
    texts = {d: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == d) for d, t in texts.items()}
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(sets):
        for b in sets:
            if b > a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    texts = {d: t for d, t in texts.items() if root[d] == d}
    for item in tables["benchmark"].collect():
        own = shingles(item.text)
        texts = {d: t for d, t in texts.items() if not own or len(own & shingles(t)) < 0.75 * len(own)}
    assert set(got) == set(texts) and 0 < len(texts) < len(rows)
    assert all(got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items())
