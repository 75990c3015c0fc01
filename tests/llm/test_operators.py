"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from lodestone.llm import bpe, decontam, kdshards, langid, line_dedup, mjpeg, neardup, ngram_lm, toxicity, urlfilter
from lodestone.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(300))
ROWS = [
    (1, LONG, "en", "a", 1), (2, LONG, "en", "b", 1), (2, LONG, "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (None, "no id at all", "en", "a", 3),
    (5, "\n\n", "en", "a", 2), (6, "A shared line of text\nown é line six", "fr", "a", 3), (7, " a SHARED line of text \nown line seven\nA shared line of text", "en", "a", 3), (8, LONG.replace("w7 ", "x "), "en", "a", 1),
    (9, "one two", "en", "a", 1), (10, "ONE two ", "en", "a", 1), (11, "🙂" * 3000 + " " + "x" * 70000, "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, none):
    got = {r.doc_id: r for r in line_dedup.line_dedup_report(docs).collect()}
    assert (got[6].n_lines, got[6].n_dropped) == (2, 0)
    assert (got[7].n_lines, got[7].n_dropped, got[7].kept_sha256) == (3, 2, hashlib.sha256(b"own line seven").hexdigest())
    assert (got[2].n_dropped, got[2].kept_sha256) == (1, hashlib.sha256(b"").hexdigest())
    assert (got[3].n_lines, got[5].n_lines, got[4].n_dropped) == (1, 3, 0)
    assert line_dedup.line_dedup_report(docs).count() == len(ROWS)
    out = line_dedup.dedup_lines(docs.selectExpr("*", "doc_id AS _h"))
    assert out.columns[-1] == "_h" and out.count() == len(ROWS)
    assert line_dedup.line_dedup_report(none).count() == 0


def test_near_dup(docs, none):
    got = {r.doc_id: r for r in neardup.near_dup_report(docs).collect()}
    assert [got[k].component_id for k in (1, 2, 8, 9, 10, 3, 4)] == [1, 1, 1, 9, 9, 3, 4]
    assert (got[3].n_shingles, got[4].n_shingles, got[9].n_shingles, got[1].n_shingles) == (0, 0, 1, 296)
    assert got[None].kept and not got[8].kept
    assert neardup.near_dup_report(none).count() == 0
    assert {r.doc_id for r in neardup.drop_near_duplicates(docs).collect()} == {1, 3, 4, None, 5, 6, 7, 9, 11}


def test_near_dup_finds_chains_of_a_large_group(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # each differs from the one before in one word: a chain, its ends far apart
        words[int(rng.integers(0, 120))] = f"n{i}"
        rows.append((i, " ".join(words)))
    found = neardup.near_dup_report(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(root))


@pytest.mark.parametrize("rounds", [0, 1, neardup.ROUNDS])
def test_near_dup_of_alike_texts_about_the_threshold(spark, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "ROWS", 40)
    monkeypatch.setattr(neardup, "COLUMNS", 50)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        words = [f"w{k}" for k in range(100)]
        for at in rng.integers(0, 100, int(rng.integers(1, 6))):
            words[at] = f"n{i}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert len(set(root)) > 5  # some stay alone beside a large component
    found = neardup.near_dup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(root))


def test_decontamination(docs, none, spark):
    items = spark.createDataFrame([(1, "w20 w21 w22 w23 w24 w25 w26 w27"), (2, "one two"), (3, None), (4, ""), (5, "never seen words in any text here"), (1, "w20 w21 w22 w23 w24 w25 w26 w27")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (8, 1), (9, 2), (10, 2)}
    assert decontam.leaks(none, items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, items).count() == len(ROWS) - 6


def test_bpe(docs, none):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in bpe.bpe_report(docs, path, pattern).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert bpe.bpe_report(none, path, pattern).count() == 0
    back = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    assert all((r["_decoded"] or b"").decode() == (r.text or "") for r in back.collect())


def test_language_model(docs, none):
    got = ngram_lm.lm_report(docs).collect()
    assert len(got) == len(ROWS) and len({r.train_tokens for r in got}) == 1
    assert all(r.score < 0 and r.n_tokens >= 1 and r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 1) for r in got)
    assert ngram_lm.lm_report(none).count() == 0


def test_media(docs, none):
    texts = {r[0]: (r[1] or "").encode() for r in ROWS}
    for r in mjpeg.media_report(docs).collect():
        data = texts[r.doc_id]
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert mjpeg.media_report(none).count() == 0


def test_clips(docs, spark):
    media = mjpeg.as_media(docs).unionByName(spark.createDataFrame([(100, None), (101, b"no media"), (102, b"RIFF\xff\xff\xff\xffAVI ")], "id long, media binary"))
    rows = mjpeg.clips(media).collect()
    assert {r.id for r in rows if r.error} == {100, 101, 102}
    shots = sorted((r.first_frame, r.n_frames) for r in rows if r.id == 11)
    assert len(shots) >= 2 and shots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(shots, shots[1:], strict=False))


def test_pixels_of_a_frame_with_detail():
    """One block with a mean and one horizontal wave: the inverse transform against its definition."""
    head = mjpeg.FRAME_HEAD[: mjpeg.FRAME_HEAD.index(b"\xff\xc0")] + mjpeg._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + mjpeg._segment(0xC4, mjpeg._table(0x00, {2: [0, 3]})) + mjpeg._segment(0xC4, mjpeg._table(0x10, {2: [0x00, 0x03]})) + mjpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    scan = np.packbits([int(c) for c in "01" "101" "01" "110" "00" "1111"]).tobytes()  # mean 5, first wave 6, end
    means, pixels = mjpeg.decode_frames([head + scan + b"\xff\xd9"], pixels=True)[0]
    x = np.arange(8)
    want = np.rint(5 * 8 / 8 + 6 * 8 * np.sqrt(1 / 8) * 0.5 * np.cos((2 * x + 1) * np.pi / 16)) + 128
    assert means[0, 0] == 133 and (pixels == want.astype(np.uint8)).all()
    assert mjpeg.decode_frames([b"\xff\xd8\xff", head])[0] is None


def test_every_language_is_learned(spark):
    rows = [(i, f"text of language {i % 70}", f"l{i % 70:02}") for i in range(140)]
    texts = spark.createDataFrame([*rows, (500, "no label", None)], "doc_id long, text string, lang string")
    net = langid.fit(texts, langid.Fit(steps=2))
    assert net.langs == [f"l{k:02}" for k in range(70)]
    assert langid.identify(texts.select("doc_id", "text"), net).where("_lang like 'l%'").count() == 141


def test_language(spark, docs, none):
    rng = np.random.default_rng(5)
    syllables = {"en": ["the", "ing", "tion", "er"], "fr": ["eau", "que", "é", "oi"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang], 2)) for _ in range(40)), lang) for i in range(120) for lang in [("en", "fr")[i % 2]]]
    texts = spark.createDataFrame([*rows, (500, None, "en"), (501, "123", "fr"), (502, "theing tion", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.lang_report(texts, langid.Fit(steps=120, batch=64)).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.95
    assert (got[500].lang_pred, got[501].lang_pred, got[502].lang_pred) == ("und", "und", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.lang_report(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), langid.Network([], 4)).selectExpr("_lang AS lang_pred").collect()} == {"und"}


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b"], 3, rng)
    net.p = {k: v.astype(np.float64).astype(np.float32) for k, v in net.p.items()}
    x, y = rng.integers(97, 100, (4, 5)), np.array([0, 1, 0, 1, 1])
    loss = lambda: -np.log(net.probabilities(x)[:, np.arange(5), y]).mean()
    g = net.gradients(x, y)
    for name, at in (("Ufz", (0, 1)), ("Ubr", (2, 0)), ("Ufn", (1, 1)), ("Wbn", (98, 2)), ("Wfr", (97, 0)), ("Vf", (1, 0)), ("c", (1,))):
        kept = net.p[name][at]
        net.p[name][at] = kept + 0.01
        up = loss()
        net.p[name][at] = kept - 0.01
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / 0.02 - g[name][at]) < 2e-4


def test_shards(docs, none, spark):
    rows = kdshards.shard_report(docs, 4).collect()
    assert len(rows) == len(ROWS) and all(r.law == "bytes" and 0 <= r.shard < 4 for r in rows)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    many = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text everywhere' ELSE repeat(concat('t', id), cast(id % 50 AS int)) END AS text")
    sizes = [r["sum(size)"] for r in kdshards.shard_report(many, 10).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 10 and max(sizes) < 1.05 * sum(sizes) / 10 and min(sizes) > 0.95 * sum(sizes) / 10
    assert kdshards.shard_report(none).count() == 0
    assert kdshards.sharded(docs, 4).columns == [*docs.columns, "_shard"]


def test_urls(spark):
    urls = [
        (1, "http://Blog.Example.COM/en/1"), (2, "https://www.example.com/en/?a=1#x"), (3, "http://a.net/fr/x"), (4, None), (5, "no scheme"), (6, "http://com"), (7, "http://x.com?y/"), (8, "http://xexample.com/en/"), (9, "ftp://a.b.net/es"), (9, "ftp://a.b.net/es"), (10, "http://a\nb.com/\n"),
    ]
    got = {r.page_id: r for r in urlfilter.url_report(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert {k: (r.host, r.path, r.rule) for k, r in got.items()} == {
        1: ("blog.example.com", "/en/1", "example.com/en/"), 2: ("www.example.com", "/en/", "www.example.com/en/"), 3: ("a.net", "/fr/x", "net/fr/"), 4: ("", "", None), 5: ("", "", None), 6: ("com", "", None), 7: ("x.com", "", None), 8: ("xexample.com", "/en/", "com/"), 9: ("a.b.net", "/es", None), 10: ("a\nb.com", "/\n", "com/"),
    }
    assert [got[k].verdict for k in (1, 2, 3, 8)] == ["block", "allow", "block", "allow"] and {r.verdict for r in got.values()} == {"allow", "block"}
    assert urlfilter.url_report(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(2)
    plain, bad = [f"word{i}" for i in range(200)], ["vilest", "hateful"]
    rows = [(i, " ".join([*rng.choice(plain, 30), *(rng.choice(bad, 6) if i % 4 == 0 else [])])) for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.toxicity_report(texts, labels).collect()
    assert np.mean([r.toxic == (r.doc_id % 4 == 0) for r in out]) > 0.98
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(ROWS)
    assert toxicity.toxicity_report(none, labels).count() == 0


def test_bpe_of_all_documents_is_the_librarys_whatever_the_blocks(spark, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    for block, replay in ((bpe.BLOCK_BYTES, bpe.REPLAY_BYTES), (100_000, 5_000)):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
        monkeypatch.setattr(bpe, "REPLAY_BYTES", replay)
        got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_report(docs, path, pattern).collect()}
        assert got == want


def test_bpe_words_that_no_bucket_answers_are_encoded_in_place(spark, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, "some words here"), (2, None), (None, "others"), (None, "others")], "doc_id long, text string")
    want = sorted(tuple(r) for r in bpe.bpe_report(docs, path, pattern).fillna(-1).collect())
    monkeypatch.setattr(bpe, "_answers", lambda asked, *_: asked.limit(0).selectExpr("block", "bucket", "1L AS sum", "words AS ids", "lengths"))
    assert sorted(tuple(r) for r in bpe.bpe_report(docs, path, pattern).fillna(-1).collect()) == want and len(want) == 4
