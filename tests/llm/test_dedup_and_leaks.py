import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from siltstone.llm import decontaminate as L
from siltstone.llm import exact_dedup as X
from siltstone.llm.common import slices, written

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_index_keeps_what_it_knows(spark):
    index = X.DigestIndex(spark, buckets=3)
    first = spark.createDataFrame([(1, "Ab", 0), (5, "aB", 0), (2, None, 0), (3, "", 0), (4, "É", 0), (6, "é", 0), (7, "x", 0), (7, "x", 0)], "doc_id long, text string, keep_id int")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.repeats) for r in X.dedup(first, index).collect()}
    assert got == {(1, 5, 2, False, 0), (5, 5, 2, True, 1), (2, 3, 2, False, 0), (3, 3, 2, True, 1), (4, 4, 1, True, 1), (6, 6, 1, True, 1), (7, 7, 2, True, 2)}
    assert index.table().count() == 5
    second = spark.createDataFrame([(9, "AB"), (8, "new"), (10, "NEW")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in X.dedup(second, index).collect()} == {(9, 5, False), (8, 10, False), (10, 10, True)}
    assert index.table().count() == 6
    again = X.DigestIndex(spark, path=index.path, buckets=3)  # the index outlives the session's table
    assert again.table().count() == 6
    assert X.dedup(first.limit(0)).count() == 0


def test_index_is_opened_as_it_was_made(spark):
    docs = spark.range(200).selectExpr("id doc_id", "concat('text ', id) text")
    with X.DigestIndex(spark, buckets=16) as index:
        assert X.dedup(docs, index).filter("kept").count() == 200
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")  # no longer what it was made with
    try:
        with X.DigestIndex(spark, path=index.path) as again:
            assert again.buckets == 16
            assert X.dedup(docs, again).filter("kept").count() == 0
            assert again.table().count() == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for wrong in ({"buckets": 4}, {"id_type": T.StringType()}):
        with pytest.raises(ValueError):
            X.DigestIndex(spark, path=index.path, **wrong)
    assert index.name not in {t.name for t in spark.catalog.listTables()}


def test_a_batch_given_again_is_decided_as_before(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "old")], "doc_id long, text string")
    with X.DigestIndex(spark, buckets=3) as index:
        X.dedup(spark.createDataFrame([(9, "old")], "doc_id long, text string"), index, batch="zero")
        first = {(r.doc_id, r.keep_id, r.kept) for r in X.dedup(docs, index, batch="one").collect()}
        assert first == {(1, 2, False), (2, 2, True), (3, 3, True), (4, 9, False)}
        assert {(r.doc_id, r.keep_id, r.kept) for r in X.dedup(docs, index, batch="one").collect()} == first
        assert index.table().count() == 3
        assert X.dedup(docs, index, batch="two").filter("kept").count() == 0


def test_index_merges_its_files(spark):
    with X.DigestIndex(spark, buckets=2, merge_after=2) as index:
        for i in range(5):
            X.dedup(spark.createDataFrame([(i, f"t{i}"), (i + 10, f"t{i}")], "doc_id long, text string"), index)
        assert index.table().count() == 5
        assert X.dedup(spark.createDataFrame([(7, "T3")], "doc_id long, text string"), index).first().keep_id == 13
        with X.DigestIndex(spark, path=index.path) as again:
            assert again.table().count() == 5


def test_rows_not_ids_are_dropped(spark):
    docs = spark.createDataFrame([(1, "aa"), (1, "unique one"), (2, "aa"), (3, "x"), (3, "x"), (4, "y"), (4, "z"), (None, "aa"), (None, None), (None, "")], "doc_id long, text string")
    docs = docs.withColumns({"digest": F.lit(1), "keep_id": F.lit("k"), "kept": F.lit(False)})  # names that the operator uses
    got = X.keep_last(docs)
    assert got.columns == docs.columns
    left = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    assert left == [("1", "unique one"), ("2", "aa"), ("3", "x"), ("4", "y"), ("4", "z"), ("None", "")]
    assert X.keep_last(docs.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a-1", "t"), ("b-2", "T"), ("c", "u")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in X.dedup(docs).collect()} == {("a-1", "b-2", False), ("b-2", "b-2", True), ("c", "c", True)}
    with X.DigestIndex(spark, buckets=2) as index, pytest.raises(ValueError):
        X.dedup(docs, index)


def test_index_side_is_not_shuffled(spark):
    index = X.DigestIndex(spark, buckets=4)
    index.append(spark.createDataFrame([(bytes(32), 1, 1, 1, "")], "digest binary, keep_id long, copies long, repeats long, batch string"))
    batch = spark.range(10).selectExpr("unhex(sha2(string(id), 256)) digest")
    plan = batch.hint("merge").join(index.table().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def brute(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(size, len(w))
        for a in range(len(w) - k + 1) if k else []:
            wins[tuple(w[a : a + k])].add(str(i))
    out = {}
    for d, t in docs:
        w = words(t)
        hit, of = set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    of |= wins[tuple(w[a : a + n])]
        out[d] = (len(w), len(hit), sorted(of))
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short ITEM"), (10, "é-ß"), (3, ""), (4, None), (5, "short item"), (None, "lost words")]
DOCS = [(1, "x one,two THREE four five; six seven eight nine ten eleven y"), (2, "a short  item, and a short item"), (3, None), (4, ""), (5, "É-ß é ß"), (6, "one two three four five six seven eight nine"), (7, "shortitem short. items")]


def test_scan_against_brute_force(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, [x for x in ITEMS if x[0] is not None])
    for block in (128 << 20, 2500):  # one automaton, and several
        got = {r.doc_id: r for r in L.scan(docs, items, block_bytes=block).collect()}
        assert {d: (r.n_words, r.n_hit, r["items"]) for d, r in got.items()} == want
        assert [DOCS[0][1][s.start : s.end] for s in got[1].spans] == ["one,two THREE four five; six seven eight nine ten eleven"]
        assert [DOCS[1][1][s.start : s.end] for s in got[2].spans] == ["short  item", "short item"]
        kept = L.keep_clean(docs.selectExpr("'x' items", "text", "doc_id"), items, block_bytes=block)
        assert kept.columns == ["items", "text", "doc_id"]
        assert {r.doc_id for r in kept.collect()} == {d for d, (_, n, _) in want.items() if not n}
    assert len(list(L._blocks(items, 10, 2500, "item_id", "text"))) > 1
    assert {r.n_hit for r in L.scan(docs, items.limit(0)).collect()} == {0}
    assert L.scan(docs.limit(0), items).count() == 0


def test_items_without_an_id_are_hit(spark):
    docs = spark.createDataFrame([(1, "some Lost, words and a short item"), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (128 << 20, 2500):
        got = {r.doc_id: (r.n_hit, r["items"]) for r in L.scan(docs, items, block_bytes=block).collect()}
        assert got == {1: (4, ["2", "5"]), 2: (0, [])}
        assert [r.doc_id for r in L.keep_clean(docs, items.filter("item_id IS NULL"), block_bytes=block).collect()] == [2]


def test_query_hashes(spark):
    r = L.query(spark, "/root/testdata/sf0.001").filter("n_hit = 0").first()
    assert (r.contaminated, r.items_sha256) == (False, hashlib.sha256(b"").hexdigest())


def test_slices_keep_all_rows(spark):
    def run(batches):
        for b in slices(batches, 0, 10):
            assert b.num_rows == 1 or sum(len(x or "") for x in b.column(0).to_pylist()) <= 10
            yield b

    rows = [("abcdef",), (None,), ("abcdef",), ("x" * 50,), ("",), ("a",)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    assert [tuple(r) for r in df.mapInArrow(run, df.schema).collect()] == rows


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.withColumnsRenamed({"source": "keep_id"})  # a name that the operators use
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    at, seen = extra, extra.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at, sf), "stage")
        assert at.columns == extra.columns
        assert at.count() <= seen
        seen = at.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in at.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in left for d in good) > 0.75 * len(good)
    assert corpus_pipeline.STAGES[-1][1](spark, at, sf).count() == seen
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text", 1), (1, "same text", 1), (2, "Same text", 2), (None, "q", 3), (3, None, 4)], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.exact(spark, docs, "")
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("2", "Same text"), ("3", None), ("None", "q")]
    doubled = corpus_pipeline.exact(spark, docs.filter("doc_id = 1"), "")
    assert doubled.count() == 1


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_later_batches_meet_the_index(spark, batches):
    """Of equal texts in different batches the anti-join leaves only the first met, that with the largest id."""
    data = [(i, f"text {i % 7}", 1) for i in range(40)] + [(3, "TEXT 3", 1), (None, "text 1", 1), (None, "alone", 1), (50, None, 1), (51, "", 1), (52, "x", 1), (52, "x", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, kept int")
    with X.DigestIndex(spark, buckets=3) as index:
        got = sorted(map(str, (tuple(r) for r in X.dedup_by_batches(docs, index, batches).drop("repeats").collect())))
        assert index.table().count() == len({(t or "").translate(FOLD) for _, t, _ in data})
        assert min(2, batches) <= index.table().select("batch").distinct().count() <= batches
    assert got == sorted(map(str, (tuple(r) for r in X.dedup(docs).drop("repeats").collect())))
    assert X.dedup_by_batches(docs.limit(0)).count() == 0
