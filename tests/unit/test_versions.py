import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import alignment as A
from siltstone.operators import ledger as G
from siltstone.operators import matching as M
from siltstone.operators import paths as P


def table_of_lengths(a, b):
    out = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + 1][j + 1] = max(out[i][j + 1], out[i + 1][j], out[i][j] + (x == y))
    return out


def plain_alignment(a, b):
    """From the whole table: backwards, the last element of ``a`` that ends what is wanted, at its first place."""
    lengths, out = table_of_lengths(a, b), []
    want = lengths[-1][-1]
    for i in reversed(range(len(a))):
        for j in range(len(b)):
            if want and a[i] == b[j] and lengths[i][j] == want - 1:
                out.append((i, j))
                want -= 1
                break
    return out[::-1]


def by_patience(a, b):
    """All matches dealt to piles, each match keeping what lay on the pile before: the chain under the last pile's top."""
    piles = []
    for i, x in enumerate(a):
        for j in sorted((j for j, y in enumerate(b) if x == y), reverse=True):
            at = next((k for k, p in enumerate(piles) if p[0][1] >= j), len(piles))
            top = ((i, j), piles[at - 1] if at else None)
            piles[at : at + 1] = [top]
    out, top = [], piles[-1] if piles else None
    while top:
        out.append(top[0])
        top = top[1]
    return out[::-1]


def test_repeated_elements_align_as_by_patience():
    r = random.Random(4)
    for _ in range(600):
        k = r.randint(1, 6)
        a, b = ([r.choice([None, "", "x", "y", "z", "é"][:k]) for _ in range(r.randint(0, 25))] for _ in range(2))
        assert A.matched(a, b) == plain_alignment(a, b) == by_patience(a, b)


def test_hot_elements_are_cheap():
    a = ["same"] * 20_000 + ["other"]
    assert A.matched(a, ["same"] * 15_000 + ["new"])[-1] == (19_999, 14_999)


def test_opcodes_cover_both(spark):
    r = random.Random(5)
    data = [(n, [r.choice("abcd") for _ in range(r.randint(0, 12))], [r.choice("abcd") for _ in range(r.randint(0, 12))], 1) for n in range(80)] + [(80, None, ["a"], 1), (81, [], [], 1), (81, [], [], 1)]
    rows = A.aligned(spark.createDataFrame(data, "id int, a array<string>, b array<string>, n int"), "a", "b")
    n, m = F.coalesce(F.size("a"), F.lit(0)), F.coalesce(F.size("b"), F.lit(0))
    n, m = F.greatest(n, F.lit(0)), F.greatest(m, F.lit(0))
    got = rows.select("id", "a", "b", A.opcodes(F.col("blocks"), n, m).alias("ops"), A.likeness(F.col("blocks"), n, m).alias("r")).collect()
    assert len(got) == 83
    for row in got:
        a, b, i, j = row.a or [], row.b or [], 0, 0
        for op in row.ops:
            assert (op.i1, op.j1) == (i, j)
            i, j = op.i2, op.j2
            if op.tag == "equal":
                assert a[op.i1 : op.i2] == b[op.j1 : op.j2]
            else:
                assert op.tag == ("replace" if op.i1 < op.i2 and op.j1 < op.j2 else "delete" if op.i1 < op.i2 else "insert")
        assert (i, j) == (len(a), len(b))
        assert row.r == (2 * table_of_lengths(a, b)[-1][-1] / (len(a) + len(b)) if a or b else 1.0)
    assert A.aligned(spark.createDataFrame([], "a array<string>, b array<string>"), "a", "b").count() == 0


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_lineages_equal_a_loop(spark, least):
    r = random.Random(6)
    words = [f"w{i}" for i in range(9)]
    data = []
    for ledger in range(4):
        for version in range(4):
            data += [(ledger, version, place, r.choice(["f", None] if ledger else ["f"]), r.sample(words, r.randint(0, 5))) for place in range(12)]
    want, n = [], 0
    met = {}
    for ledger, version, place, anchor, w in data:  # in order
        n = max([m[0] for (k, _), v in met.items() if k == ledger for m in v], default=0)
        best, line = 0, None
        for old, words_ in met.get((ledger, anchor), []):
            s = len(set(w) & set(words_)) / len(set(w) | set(words_)) if w or words_ else 1.0
            if s > best:
                best, line = s, old
        if best < least:
            line = n + 1
        met.setdefault((ledger, anchor), []).append((line, w))
        want.append((ledger, version, place, line))
    items = spark.createDataFrame(data, "ledger int, version int, place int, anchor string, words array<string>").repartition(3)
    assert sorted(map(tuple, G.lineages(items, least).collect())) == sorted(want)
    assert G.lineages(items.limit(0)).count() == 0


def test_lineages_in_blocks(spark, monkeypatch):
    """A ledger of many blocks, with words that most items have: as by a loop, and items are not written once for each of their words."""
    r = random.Random(12)
    some = [f"w{i}" for i in range(60)]
    data = [("x" if i % 9 else f"y{i}", f"v{i // 10:02d}", i % 10, r.choice("fg"), [*r.sample(["the", "a", None], r.randint(0, 3)), *r.sample(some, r.randint(0, 4))]) for i in range(260)]
    want, met, lines = [], {}, {}
    for ledger, version, place, anchor, w in data:
        best, line = 0.3, None
        for old, other in met.get((ledger, anchor), []):
            s = len(set(w) & set(other)) / len(set(w) | set(other)) if w or other else 1.0
            if s > best or (s == best and line is None):
                best, line = s, old
        if line is None:
            line = lines[ledger] = lines.get(ledger, 0) + 1
        met.setdefault((ledger, anchor), []).append((line, w))
        want.append((ledger, version, place, line))
    seen, real = [], G.written
    monkeypatch.setattr(G, "ITEMS", 40, raising=False)
    monkeypatch.setattr(G, "written", lambda df, name: seen.append(real(df, name)) or seen[-1])
    items = spark.createDataFrame(data, "ledger string, version string, place int, anchor string, words array<string>").repartition(3)
    assert sorted(map(tuple, G.lineages(items).collect())) == sorted(want)
    assert max(df.count() for df in seen) <= len(data)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(G, "written", lambda df, name: (rounds.append(name), df.sparkSession.createDataFrame(df.collect(), df.schema))[1])
    links = spark.range(300).selectExpr("1 as k", "id as node", "greatest(id - 1, 0) as up")
    assert G.roots(links, ["k"], "node", "up").filter("up <> 0").count() == 0
    assert len(rounds) <= 11


HAVE = "scope string, path array<string>, name string, kind string, q boolean, line int"


def test_path_union(spark):
    have = [("s", ["a", "x"], "x", "name", True, 1), ("s", ["a", "b", "y"], "y", "name", True, 2), ("s", ["a", "z"], "z", "name", False, 3), (None, ["a"], "a", "name", True, 0), ("s", [], None, "name", True, 0)]
    want = [
        ("s", ["a", "x"], "x", "name", True),  # there already
        ("s", ["a", "new"], "new", "name", True),
        ("s", ["a", "new"], "new", "name", True),
        ("s", ["a", "b", "n"], "n", "name", True),
        ("s", ["a", "b", "c", "n"], "n", "name", True),
        ("s", ["a", "other"], "x", "name", True),
        ("s", ["a", "p"], "same", "name", True),
        ("s", ["a", "q"], "same", "name", True),
        ("s", ["a", "u"], None, "name", True),
        ("s", ["a", "v"], None, "name", True),
        ("s", ["a", "w"], "w", "name", False),
        ("s", ["a", "*"], None, "glob", True),
        ("s", ["one"], "one", "name", True),
        ("s", [], None, "name", True),  # there, too
        ("s", None, None, "name", True),
        (None, ["a", "k"], "k", "name", True),
        ("t", ["a", "k"], "k", "name", True),
    ]
    wanted = spark.createDataFrame([w[:5] for w in want], HAVE.rsplit(",", 1)[0])
    got = {(r.scope, tuple(r.path)): (r.dest, r.outcome) for r in P.path_union(spark.createDataFrame(have, HAVE), wanted, ["q"]).collect()}
    assert got == {
        ("s", ("a", "new")): (1, "added"),
        ("s", ("a", "b", "n")): (2, "added"),
        ("s", ("a", "b", "c", "n")): (None, "no_destination"),
        ("s", ("a", "other")): (1, "collision"),
        ("s", ("a", "p")): (1, "collision"),
        ("s", ("a", "q")): (1, "collision"),
        ("s", ("a", "u")): (1, "added"),
        ("s", ("a", "v")): (1, "added"),
        ("s", ("a", "w")): (1, "other_domain"),
        ("s", ("a", "*")): (None, "glob"),
        ("s", ("one",)): (None, "no_prefix"),
        (None, ("a", "k")): (0, "added"),
        ("t", ("a", "k")): (None, "no_destination"),
    }
    empty = spark.createDataFrame([], HAVE)
    assert P.path_union(empty, wanted.limit(0), ["q"]).count() == 0
    assert {r.outcome for r in P.path_union(empty, wanted, ["q"]).collect()} == {"glob", "no_prefix", "no_destination"}


def plain_matches(old, new, sign, sure, maybe):
    names, used, out = {(k, n) for k, n, *_ in new}, set(), []
    for kind, name, i, v, mark in sorted(old, key=lambda r: r[2]):
        if (kind, name) in names or v is None or not any(v):
            continue
        best = None
        for k, _, j, w, other in sorted(new, key=lambda r: r[2]):
            if k != kind or j in used or w is None or not any(w):
                continue
            u, x = np.array(v) / np.linalg.norm(v), np.array(w) / np.linalg.norm(w)
            s = round(float(u @ x), 9)
            if (s >= sure or (s >= maybe and sign(mark, other))) and (best is None or s > best[1]):
                best = (j, s)
        if best:
            used.add(best[0])
            out.append((i, best[0], "renamed" if best[1] >= sure else "possibly_renamed"))
    return sorted(out)


def test_vector_matches_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)  # cells in many blocks
    r = np.random.default_rng(8)
    centres = r.standard_normal((6, 5))
    row = lambda i: ("ab"[i % 2], f"n{i // 3}", i, (centres[r.integers(6)] + 0.4 * r.standard_normal(5)).round(3).tolist(), bool(r.integers(2)))
    old, new = [row(i) for i in range(90)], [row(i + 1000 if i % 4 else i) for i in range(80)]
    old += [("a", "x", 200, None, True), ("a", "y", 201, [0.0] * 5, True), (None, "z", 202, [1.0] * 5, True)]
    new += [("a", "v", 2000, old[0][3], True), ("a", "w", 2001, old[0][3], True), (None, "q", 2002, [1.0] * 5, False), ("a", "u", 2003, None, True)]
    ddl = "kind string, name string, id long, vec array<double>, mark boolean"
    a, b = (spark.createDataFrame(x, ddl).repartition(3) for x in (old, new))
    got = M.matched_by_vector(a, b, F.expr("a.mark = b.mark"), 0.85, 0.7).collect()
    assert sorted((x.a, x.b, x.how) for x in got) == plain_matches(old, new, lambda x, y: x == y, 0.85, 0.7)
    every = {(x.a, x.b) for x in M.near_pairs(a, b, 0.7).collect()}
    some = {(x.a, x.b) for x in M.near_pairs(a, b, 0.7, probes=4).collect()}
    assert some <= every and len(some) >= 0.99 * len(every)
    assert M.matched_by_vector(a.limit(0), b, F.lit(True)).count() == 0
    assert M.matched_by_vector(a, b.limit(0), F.lit(True)).count() == 0


def test_vector_matches_ask_again(spark, monkeypatch):
    """A few partners at a time, copies of vectors among them, in blocks that each hold a few rows of either side; ids as text too."""
    r = np.random.default_rng(3)
    base = r.standard_normal((25, 4)).round(3).tolist()
    row = lambda i, n: ("ab"[i % 2], f"n{n}", i, base[r.integers(25)], bool(r.integers(2)))
    old, new = [row(i, i) for i in range(100, 190)], [row(i, -i) for i in range(200, 280)]
    ddl = "kind string, name string, id long, vec array<double>, mark boolean"
    monkeypatch.setattr(M, "TOP", 1)
    monkeypatch.setattr(M, "BLOCK", 16), monkeypatch.setattr(M, "WIDE", 2), monkeypatch.setattr(M, "ONCE", 64)
    a, b = (spark.createDataFrame(x, ddl).withColumn("id", F.col("id").cast("string")) for x in (old, new))
    got = M.matched_by_vector(a, b, F.expr("a.mark = b.mark"), 0.8, -1.0).collect()
    assert sorted((int(x.a), int(x.b), x.how) for x in got) == plain_matches(old, new, lambda x, y: x == y, 0.8, -1.0)


def test_near_vectors_are_not_copied_to_most_cells(spark, monkeypatch):
    """Where most cells may hold a partner, rows of neither side are copied to each of them, nor are all pairs listed."""
    seen, real = {}, M.written
    monkeypatch.setattr(M, "written", lambda df, name: seen.setdefault((name, len(seen)), real(df, name)))
    r = np.random.default_rng(4)
    rows = spark.createDataFrame([("k", i, i, r.standard_normal(16).tolist()) for i in range(1000)], "kind string, name int, id int, vec array<double>")
    assert M.matched_by_vector(rows.filter("id < 500"), rows.filter("id >= 500"), F.lit(True), 0.9, -0.5).count() == 500
    most = max(df.count() for df in seen.values())
    assert most <= M.TOP * 500


def test_vector_matches_on_the_table(spark):
    from siltstone.plans import registry

    path = "/root/testdata/sf0.001"
    rows = [("k" + str(r.label), r.vec_id // 2, r.vec_id, r.embedding, r.embedding[0] > 0) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = plain_matches([r for r in rows if r[2] % 2 == 0], [r for r in rows if r[2] % 2], lambda x, y: x == y, 0.4, 0.25)
    registry.load()
    assert len(want) > 20
    assert sorted((x.a, x.b, x.how) for x in registry.QUERIES["vector_matches"](spark, path).collect()) == want


def test_taken_in_turn_undoes_what_was_kept(spark):
    """A later row holds what an earlier one wants in the end."""
    pairs = [(1, "x", 0.9), (2, "x", 0.9), (2, "y", 0.8), (3, "y", 0.9), (3, "z", 0.1), (4, "z", 0.5), (4, "z", 0.5)]
    got = M.taken_in_turn(spark.createDataFrame(pairs, "a int, b string, score double")).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, "x"), (2, "y"), (3, "z")]
