import random
import zlib

import numpy as np

from siltstone.llm import language_id as L
from siltstone.llm import quality_cnn as Q


def longest_matches(text, train):
    """Phrases of a greedy parse, by searching."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and tuple(text[at : at + k + 1]) in train:
            k += 1
        at += k
        n += 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(4)
    train = {"a": "the cat sat on the mat and the dog", "b": "el gato y el perro en la casa"}
    langs = L.Languages(train)
    texts = ["the dog and the cat", "el perro", "zzz qq", "x", "ñandú the", "".join(rng.choice("abcdeht ") for _ in range(200))]
    got, size = langs.phrases(texts)
    for k, name in enumerate(langs.names):
        coded = L.letters(train[name], langs.codes).tolist()
        grams = {tuple(coded[i:j]) for i in range(len(coded)) for j in range(i + 1, min(len(coded), i + 60) + 1)}
        for i, t in enumerate(texts):
            assert got[i, k] == longest_matches(L.letters(t, langs.codes).tolist(), grams), (name, t)
    names, sure = langs.predict(["the cat", "el gato", "123 !!", ""])
    assert names == ["a", "b", "und", "und"] and sure[2] == sure[3] == 0


def test_lanes_only_cut_phrases():
    langs = L.Languages({"a": "the cat sat on the mat " * 30, "b": "el gato y el perro " * 30})
    text = "the cat sat on the mat " * 40
    got, _ = langs.phrases([text])
    assert got[0, 0] < got[0, 1]


def test_every_letter_of_the_training_texts_counts():
    many = "".join(chr(0x4E00 + i) for i in range(80))
    langs = L.Languages({"zh": many * 60, "el": "η γάτα και ο σκύλος " * 3, "ru": "кошка и собака дома " * 3})
    names, _ = langs.predict(["η γάτα", "и собака", "ο σκύλος", "кошка"])
    assert names == ["el", "ru", "el", "ru"]
    assert len({int(langs.codes[ord(c)]) for c in many + "ηγκш"}) == len(many) + 4


def test_wide_tables_are_held_as_matches(monkeypatch):
    train = {"a": "the cat sat on the mat " * 9, "zh": "".join(chr(0x4E00 + i * i % 900) for i in range(700))}
    texts = ["the cat on a mat", train["zh"][30:400], "x", "", "η" + train["zh"][5:9] + " the"]
    whole = L.Languages(train).phrases(texts)
    monkeypatch.setattr(L, "DENSE", 0)
    narrow = L.Languages(train)
    assert all(isinstance(t, L.Matches) for t in narrow.tables)
    for x, y in zip(whole, narrow.phrases(texts), strict=True):
        assert np.array_equal(x, y)


def test_languages_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = L.query(spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 1.0), (2, None, "en", 1.0), (3, "42", None, 1.0), (None, "the dog and cat", "en", 1.0)], "doc_id long, text string, lang string, score double")
    none = L.identify(docs, {})
    assert {r.lang_pred for r in none.collect()} == {"und"}
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, L.sample(docs)).collect()}
    assert got[2] == got[3] == "und"
    assert L.identify(docs.limit(0), {"en": "the"}).count() == 0
    assert L.sample(docs.limit(0)) == {}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = Q.Network.new(4, 1)
    for n in ("emb", "filters", "bias", "mix", "mix_bias", "out", "off"):
        setattr(net, n, getattr(net, n).astype(np.float64))
    texts = [bytes(rng.integers(1, 255, n, dtype=np.uint8)) for n in (5, 300, 900)]
    rows, first = Q.chunks(texts)
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        hidden = np.maximum(net.pooled(rows) @ net.mix + net.mix_bias, 0)
        p = net._combined(hidden, first)[1]
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum()

    grads = dict(zip(("emb", "filters", "bias", "mix", "mix_bias", "out", "off"), net.gradients(rows, first, label, weight), strict=True))
    for name, g in grads.items():
        value = getattr(net, name)
        for i in np.argsort(-np.abs(g), axis=None)[:3]:
            at = np.unravel_index(i, g.shape)
            old, eps = value[at], 1e-6
            value[at] = old + eps
            up = loss()
            value[at] = old - eps
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-3 * max(1, abs(g[at])), name


def loop_score(net, text):
    """The network's probability by loops over chunks, places and filters."""
    pooled_chunks = []
    for at in range(0, max(1, len(text) - Q.OVERLAP), Q.CHUNK - Q.OVERLAP):
        chunk = text[at : at + Q.CHUNK].ljust(Q.CHUNK, b"\0")
        best = np.full(net.filters.shape[1], -np.inf)
        for i in range(0, Q.CHUNK - Q.STRIDE, Q.STRIDE):
            window = np.concatenate([net.emb[b] for b in chunk[i : i + 2 * Q.STRIDE]])
            for f in range(len(best)):
                best[f] = max(best[f], sum(float(x) * float(w) for x, w in zip(window, net.filters[:, f], strict=True)) + float(net.bias[f]))
        pooled_chunks.append(np.maximum(np.maximum(best, 0) @ net.mix + net.mix_bias, 0))
    both = np.concatenate((np.mean(pooled_chunks, axis=0), np.max(pooled_chunks, axis=0)))
    return 1 / (1 + np.exp(-(both @ net.out + net.off[0])))


def test_scores_are_those_of_plain_loops():
    net = Q.Network.new(3, 5)
    rng = np.random.default_rng(1)
    texts = [b"", b"a", "Größe é".encode(), bytes(rng.integers(1, 255, 255, dtype=np.uint8)), bytes(rng.integers(1, 255, 257, dtype=np.uint8)), bytes(rng.integers(1, 255, 700, dtype=np.uint8))]
    for t, p in zip(texts, net.score(texts), strict=True):
        assert abs(p - loop_score(net, t)) < 1e-4


def test_long_texts_are_scored_whole(spark):
    net = Q.Network.new(8, 5)
    long = "some words of a very long text, " * 60_000  # 2 MB
    docs = spark.createDataFrame([(1, long + "\u20ac end"), (2, long)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in Q.score(docs, net).collect()}
    assert abs(got[1] - net.score([(long + "\u20ac end").encode()])[0]) < 1e-9 and got[1] != got[2]


def test_chunks_cover_all_bytes():
    texts = [b"", b"a", bytes(range(256)) * 5, b"x" * Q.CHUNK, b"y" * (Q.CHUNK + 1)]
    rows, first = Q.chunks(texts)
    for i, t in enumerate(texts):
        got = rows[first[i] : first[i + 1]]
        whole = b"".join(r.tobytes()[(Q.OVERLAP if k else 0) :] for k, r in enumerate(got))
        assert whole[: len(t)] == t and not whole[len(t) :].strip(b"\0")


def test_quality_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in Q.query(spark, sf).collect()}
    assert len(got) == 1000 and all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    held = [d for d in label if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in label)
    assert np.mean([got[d].predicted == label[d] for d in held]) > 0.95
    assert np.mean([got[d].predicted for d in held if label[d]]) > 0.95


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x" * 5000, 0), (3, "fine text", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (3, None), (2, 7), (None, 0)], "doc_id long, quality int")
    net = Q.fit(docs, labels)
    assert Q.score(docs, net).count() == 4
    assert Q.keep_good(docs, net).columns == docs.columns
    assert Q.score(docs.limit(0), Q.fit(docs, labels.limit(0))).count() == 0
