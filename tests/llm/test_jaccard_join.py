import random
import re

import numpy as np

from siltstone.llm import components as C
from siltstone.llm import jaccard_join as J
from siltstone.llm import shingles as S
from siltstone.llm.common import perhaps
from siltstone.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(texts):
    """Links and classes of ``id -> text`` by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    links, parent = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def got(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(J.query(spark, "/root/testdata/sf0.001")) == brute({r.doc_id: r.text for r in docs.collect()})


def family(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_large_families_and_common_passages(spark):
    rng = random.Random(5)
    line = " ".join(f"line{i}" for i in range(12))
    texts = family(320, 150, 3, 1) + family(60, 90, 2, 2) + [line + " " + " ".join(f"r{rng.randrange(10**7)}" for _ in range(40)) for _ in range(300)]
    texts += [texts[0].upper(), texts[0] + " !", "", None, "one two", "One, two"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(J.near_duplicates(docs)) == brute(dict(rows))


def test_splitting_finds_what_brute_force_finds(spark, monkeypatch):
    texts = family(120, 80, 2, 3) + family(40, 60, 1, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = J.candidates
    monkeypatch.setattr(J, "candidates", lambda reps, s, r: plain(reps, s, r, limit=8, dense=1.1))
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "MOST", 24)
    assert got(J.near_duplicates(docs)) == brute(dict(enumerate(texts)))


def test_blocks_by_size_lose_no_link(spark, monkeypatch):
    """A chain of texts of growing length, each like the next, in one family: many bands."""
    rng = random.Random(9)
    words = [f"c{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words[:n]) for n in range(20, 400, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, most in ((8, 8), (16, 64)):
        monkeypatch.setattr(J, "BLOCK", block)
        monkeypatch.setattr(J, "MOST", most)
        monkeypatch.setattr(J, "BYTES", 20_000)
        assert got(J.near_duplicates(docs)) == brute(dict(enumerate(texts)))


def test_nulls_repeats_empty_tables_and_extra_columns(spark):
    t = "a b c d e f g"
    docs = spark.createDataFrame([(1, t, 5), (1, t, 6), (2, t, 7), (None, t, 8), (3, None, 9), (4, "", 9), (None, "h i", 9)], "doc_id long, text string, class_id long")
    rows = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.kept) for r in J.near_duplicates(docs).collect())
    assert rows == [("1", "1", 3, True), ("1", "1", 3, True), ("2", "1", 3, False), ("3", "3", 0, True), ("4", "4", 0, True), ("None", "1", 3, False), ("None", "None", 0, True)]
    assert J.near_duplicates(docs.limit(0)).count() == 0
    assert {r.n_links for r in J.near_duplicates(docs.filter("text is null")).collect()} == {0}


def test_rows_not_ids_stay(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame([(1, t, 0), (1, "something else altogether here now", 0), (2, t + " !", 0), (2, "and a third one of its own", 0), (1, t, 0), (None, t.upper(), 0), (None, None, 0), (5, "", 0)], "doc_id long, text string, kept int").withColumnRenamed("kept", "digest")
    left = J.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == [("1", t), ("1", "something else altogether here now"), ("2", "and a third one of its own"), ("5", ""), ("None", "")]
    assert J.keep_one(docs.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    t = "a b c d e f g h i"
    docs = spark.createDataFrame([("x-1", t), ("b", t.upper()), ("c", "q")], "doc_id string, text string")
    assert got(J.near_duplicates(docs)) == {"x-1": ("b", 1), "b": ("b", 1), "c": ("c", 0)}


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (500, 500)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert labels == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_bits_let_all_wanted_rows_pass(spark):
    texts = spark.range(3000).selectExpr("id", "string(id) text", "unhex(md5(string(id))) digest")
    wanted = texts.filter("id % 30 = 0").select("digest")
    for bits, most in ((26, 110), (10, 500), (4, 3000)):
        got = {r.id for r in perhaps(texts, texts.digest, wanted, bits).filter("_may").collect()}
        assert got >= set(range(0, 3000, 30)) and len(got) <= most
    assert perhaps(texts, texts.digest, wanted.limit(0)).filter("_may").count() == 0


def test_shingles_of_segments_and_parts(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "of", "né", "x1", "A", "..."]) + rng.choice(["", ",", "  "]) for _ in range(rng.randrange(120))).encode() for _ in range(80)] + [b"", b"a b", b"z" * 300]
    h, first, words, keys = S.hashed(texts)
    for i, t in enumerate(texts):
        assert len(np.unique(h[first[i] : first[i + 1]])) == len(shingle_set(t.decode()))
    monkeypatch.setattr(S, "SEGMENT", 50)
    h2, first2, words2, keys2 = S.hashed(texts)
    assert keys == keys2 and (words == words2).all()
    for a, b in zip(S.distinct(h, first), S.distinct(h2, first2), strict=True):
        assert np.array_equal(a, b)


def test_recall_of_runs():
    assert J.runs_for(0.999, 0.8, 2) >= J.runs_for(0.99, 0.8, 2) > 1
    assert 0 < J.chance(0.8, 0.8, 3) < J.chance(0.8, 0.8, 1) < J.chance(0.8, 1.0, 1) < 1


def test_recall_holds_however_deep_buckets_are_split(spark, monkeypatch):
    """The first runs are enough for SHALLOW splits; what was split more often goes through the runs that the depth takes."""
    asked, split = [], J._split
    monkeypatch.setattr(J, "_split", lambda runs, similarity: asked.append(runs) or split(runs, similarity))
    sketch = [(i, bytes(range(256)), bytes(64)) for i in range(12)]  # all alike: every bucket is large
    reps = spark.createDataFrame(sketch, "node long, sketch binary, short binary")
    for depth in (2, 4):
        asked.clear()
        J.candidates(reps, limit=8, dense=1.1, depth=depth)
        assert 1 - (1 - J.chance(0.8, 0.8, depth)) ** len({r for runs in asked for r in runs}) >= 0.999


def test_equal_buckets_are_split_in_every_run(spark, monkeypatch):
    levels, plain = [], J.written

    def noted(df, name):
        out = plain(df, name)
        if name == "split":
            levels.append(out)
        return out

    monkeypatch.setattr(J, "written", noted)
    sketch = [(i, bytes(range(256)), bytes(64)) for i in range(12)]  # all alike: the same documents in every bucket
    J.candidates(spark.createDataFrame(sketch, "node long, sketch binary, short binary"), limit=8, dense=1.1, depth=2)
    assert levels[0].select("key").distinct().count() > J.runs_for(0.999, 0.8, 2) / 2


def test_few_rows_are_few_files_however_many_partitions(spark, monkeypatch):
    """Each file that a task writes to a local folder starts a child of its JVM: edges and links of many tasks, and the rows returned, are few files."""
    files, plain = {}, C.written

    def noted(df, name):
        out = plain(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(C, "written", noted)
    monkeypatch.setattr(J, "written", noted)
    texts = [t for seed in range(40) for t in family(3, 40, 1, seed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 48)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        rows = J.near_duplicates(docs)
        assert got(rows) == brute(dict(enumerate(texts)))
        assert rows.rdd.getNumPartitions() == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"edges", "links", "labels", "sets", "copies"} <= set(files) and max(files.values()) <= 3
