import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import learned_ann as A
from siltstone.llm import lexical_search as S
from siltstone.llm import merkle as M

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf int"




@pytest.mark.parametrize("name, module", [("op11_lexical_search", S), ("op13_merkle", M)])
def test_query_is_its_sql(spark, name, module):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    theirs = con.execute(module.ORACLE)
    names = [c[0] for c in theirs.description]
    ours = module.query(spark, DIR).select(names).collect()
    assert sorted(map(str, map(tuple, ours))) == sorted(map(str, theirs.fetchall()))


def plain_search(docs, items, k):
    found = [(i, Counter(WORD.findall((t or "").translate(FOLD)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        if text is None:
            continue
        asked = [t for t in WORD.findall(text.translate(FOLD)) if t in df]
        best = []
        for i, c in found:
            m = 75 + 25 * c.total() * n // max(total, 1)
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked)
            if score > 0:
                best.append((score, i))
        best.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best[:k])]
    return sorted(map(str, out))


def test_lexical_search(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "Ab", "aB", "日本", "9"]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, text(rng.integers(0, 30)), 7) for i in range(150)] + [(7, "ab ab", 7), (None, "AB; w1", 7), (201, None, 7), (202, "", 7), (203, "?! --", 7), (204, "w1 " * 60_000, 7)]
    docs += [(300 + i, "w3 w3 w3 w5", 7) for i in range(60)]  # more equal scores than places
    items = [(1, text(8)), (2, "w3 w5 w3"), (3, None), (4, ""), (5, "unknown"), (6, "aB AB ab é"), (6, "w1"), (None, "w2 日本")]
    spread = spark.createDataFrame(docs, "doc_id long, text string, rank int").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for size, block in ((S.SHARD, S.BLOCK), (400, 20)):
        index = S.build(spread, shard_bytes=size)
        got = S.search(index, asked, k=20, block=block).collect()
        assert sorted(map(str, map(tuple, got))) == plain_search([d[:2] for d in docs], items, 20)
    assert S.search(S.build(spread.limit(0)), asked).count() == 0
    assert S.search(index, asked.limit(0)).count() == 0


def test_tree_follows_ranges():
    rng = np.random.default_rng(1)
    docs = rng.integers(0, 37, 500)
    tree = S.Tree.unpack(S.Tree.of(docs, 37).pack(), 500)
    lo, hi = np.array([100]), np.array([260])
    for want in (0, 5, 31, 36):
        a, b = lo, hi
        for level in range(len(tree.levels)):
            bit = want >> (len(tree.levels) - 1 - level) & 1
            a, b = tree.halves(level, a)[bit], tree.halves(level, b)[bit]
        assert b[0] - a[0] == (docs[100:260] == want).sum()


def plain_nearest(rows, k, chosen):
    out = {}
    for q in rows:
        if chosen(q):
            scores = sorted((-float(A.exact_scores(rows[q][None], rows[i][None])[0]), i) for i in rows if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_nearest_on_whole_tables(spark):
    """Recall of the query, and that what it finds is scored and ordered as said."""
    table = duckdb.sql("SELECT vec_id, embedding FROM read_parquet('/root/testdata/sf0.1/embeddings.parquet')").fetchall()
    rows = {i: np.array(v, np.float64) for i, v in table}
    want = plain_nearest(rows, 20, lambda q: q % 20 == 0)
    index = A.LearnedIndex(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), part_rows=128)
    assert index.router.value.parts > 4
    assert index.entries.count() == len(rows)
    asked = index.rows.filter("vec_id % 20 = 0")
    for probes, least in ((None, 0.9), (index.router.value.parts, 1.0)):
        got = defaultdict(list)
        for r in sorted(index.search(asked, probes).collect()):
            assert r.score == float(A.exact_scores(rows[r.query_id][None], rows[r.vec_id][None])[0])
            got[r.query_id].append((r.vec_id, r.score))
        assert all(x == sorted(x, key=lambda y: (-y[1], y[0])) and len(x) == 20 for x in got.values())
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= least * 20 * len(want)
    assert sorted(got) == sorted(want)


def test_nearest_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(5)
    rows = {i: rng.standard_normal(6).astype(np.float32) for i in range(300)}
    same = rng.standard_normal(6).astype(np.float32)
    rows |= {i: same for i in range(300, 420)}  # a vector of more rows than are asked for
    bad = [(500, None), (520, [0.0] * 6), (540, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (560, [float("nan")] * 6), (580, [float("inf")] * 6), (600, [1.0, 2.0]), (None, [1.0] * 6), (620, [])]
    data = [(i, v.tolist(), 1) for i, v in rows.items()] + [(i, v, 1) for i, v in bad] + [(0, rows[0].tolist(), 1)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int").repartition(4)
    got = defaultdict(list)
    for r in sorted(A.nearest(frame, F.col("vec_id") % 20 == 0, part_rows=64, target=1.0, asked=500).collect()):
        got[r.query_id].append((r.vec_id, r.score))
    want = plain_nearest({i: v.astype(np.float64) for i, v in rows.items()}, 20, lambda q: q % 20 == 0)
    assert dict(got) == want
    few = spark.createDataFrame(data[:5], frame.schema)
    assert A.nearest(few, F.col("vec_id") == 0).count() == 4
    assert A.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_blocks_meet_all(spark):
    rng = np.random.default_rng(6)
    rows = {i: rng.standard_normal(4) for i in range(200)}
    index = A.LearnedIndex(spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>"), k=3, part_rows=50)
    found = index.search(index.rows, index.router.value.parts, row_block=16, query_block=7)
    got = defaultdict(list)
    for r in sorted(found.collect()):
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == plain_nearest(rows, 3, lambda q: True)


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((130, 8)) + 4 * rng.standard_normal(8) for _ in range(4)])
    graph = A.neighbour_graph(x, 5)
    part = A.balanced_parts(graph, 4, rng)
    sizes = np.bincount(part)
    assert len(sizes) == 4 and sizes.max() - sizes.min() <= 2
    assert (part[graph] == part[:, None]).mean() > 0.95
    router = A.train_router(x, graph, part, 4, rng)
    assert (router.scores(x).argmax(axis=1) == part).mean() > 0.9


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    """The root, and for each leaf the siblings and their places."""
    level, paths = [(d, [i]) for i, d in enumerate(leaves)], [[] for _ in leaves]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            for j, (_, under) in enumerate(run):
                for i in under:
                    paths[i].append(([d for d, _ in run[:j]], [d for d, _ in run[j + 1 :]]))
            above.append((digest(*[d for d, _ in run]), [i for _, under in run for i in under]))
        level = above
    return level[0][0], paths


def plain_manifest(rows, fanout=2):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf, claim = (digest(*map(field, (doc_id, source, lang, n, text))) for n in (n_chars, n_chars + 1 if n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else n_chars))
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id, claim))
    if not groups:
        return []
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, over = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, over, strict=True):
        for (_, _, leaf, doc_id, claim), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            folded = claim
            for left, right in path + up:
                folded = digest(*left, folded, *right)
            out.append((doc_id, leaf, trees[g][0], root, digest(*[d for left, right in path + up for d in left + right]), folded, folded == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 70])
def test_merkle(spark, tmp_path, n):
    rows = [(i, f"té{i}", ["en", "de", None, "zz"][min(3, i % 11)], None if i % 5 == 0 else "web", None if i % 3 == 0 else i, 1) for i in range(n)]
    if n > 20:
        rows += [(3, "again", "zz", None, 2, 1), (3, "again", "zz", None, 2, 1), (None, None, None, None, None, 1), (900, "x" * 300_000, "fr", "a", 3, 1), (-5, "", "", "", 2**62, 1)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.query(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(str, map(tuple, got))) == plain_manifest(rows)


def test_merkle_in_bands_and_rounds(spark, monkeypatch):
    """Narrow bands and spans, so that many steps are needed; also with a fan-out of three."""
    monkeypatch.setattr(M, "BAND", 2)
    monkeypatch.setattr(M, "WIDER", 4)
    rows = spark.range(300).select("id", F.when(F.col("id") % 10 < 8, "a").otherwise("b").alias("lang"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(None).cast("binary").alias("claim"))
    for fanout in (2, 3):
        found, root = M.manifest(rows, fanout=fanout)
        found = found.collect()
        assert len(found) == 300 and all(bytes(r.folded).hex() == root for r in found)
        for g, part in (("a", [i for i in range(300) if i % 10 < 8]), ("b", [i for i in range(300) if i % 10 >= 8])):
            top, paths = plain_tree([digest(str(i)) for i in part], fanout)
            assert {bytes(r.subroot).hex() for r in found if r.tree == g} == {top}
