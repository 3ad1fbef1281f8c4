"""Texts of over a megabyte, rows that repeat and columns with the operators' own names, through the operators on documents."""

import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate as D
from siltstone.llm import exact_dedup as X
from siltstone.llm import jaccard_join as J
from siltstone.llm import language_id as L
from siltstone.llm import quality_cnn as Q
from siltstone.llm import wrapper as H

WORDS = " ".join(f"word{i * 7919 % 10007}" for i in range(170_000))  # 1.6 MB
PASSAGE = "one two three four five six seven eight nine ten eleven"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, WORDS), (2, WORDS + " end"), (3, WORDS.upper()), (4, WORDS + " " + PASSAGE), (5, "short text"), (5, "short text"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(k) for k in ("lang", "digest", "keep_id", "class_id", "items", "score", "node", "copy_key")})


def test_exact_copies(docs):
    got = {(r.doc_id, r.keep_id, r.group_size) for r in X.dedup(docs).collect()}
    assert got == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 4, 1), (5, 5, 2), (6, 6, 1)}


def test_near_copies(docs):
    got = {(r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(docs).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 1, 3), (5, 5, 1), (6, 6, 0)}
    assert sorted(r.doc_id for r in J.keep_one(docs).select("doc_id").collect()) == [1, 5, 6]


def test_benchmark_passages(spark, docs):
    items = spark.createDataFrame([("a", PASSAGE, 0)], "item_id string, text string, doc_id int")
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.end) for s in r.spans)) for r in D.scan(docs, items).collect()}
    assert (4, 170_011, 11, ("a",), ((len(WORDS) + 1, len(WORDS) + 1 + len(PASSAGE)),)) in got and sum(x[2] for x in got) == 11
    assert sorted(r.doc_id for r in D.keep_clean(docs, items).select("doc_id").collect()) == [1, 2, 3, 5, 5, 6]


def test_languages(docs):
    got = {(r.doc_id, r.lang_pred) for r in L.identify(docs, {"a": "word short text", "b": "qqq xyz"}).collect()}
    assert got == {(i, "a") for i in range(1, 6)} | {(6, "und")}


def test_quality(docs):
    net = Q.Network.new(4, 1)
    assert Q.score(docs, net).count() == 7
    got = {r.doc_id: r.score for r in Q.score(docs, net).collect()}
    assert abs(got[2] - net.score([(WORDS + " end").encode()])[0]) < 1e-9


def test_pages(spark):
    html = "<nav>menu</nav><article><p>" + WORDS + "</p></article>"
    rows = [(1, "http://a/", html), (1, "http://a/", html), (2, "http://a/2", html + "x")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(k) for k in ("host", "layout", "packed", "wrapper", "keys", "text")})).collect()
    assert [r.text for r in got] == [WORDS] * 3
