import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import sequences as Q
from siltstone.functions import stats as S
from siltstone.functions import text as X
from siltstone.operators import calibration as C
from siltstone.operators import design as D
from siltstone.operators import lines as L
from siltstone.operators import merge as M


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=25), st.text("abcd", max_size=25))
def test_sequences_against_the_plain_table(a, b):
    n = lcs(a, b)
    assert Q.common_length(a, b) == n == len(Q.matches(list(a), list(b)))
    out = []
    for r in Q.edit_runs(list(a), list(b)):
        assert (a[r["i1"] : r["i2"]] == b[r["j1"] : r["j2"]]) == (r["tag"] == "equal")
        out.append(b[r["j1"] : r["j2"]])
    assert "".join(out) == b


def test_udfs(spark):
    df = spark.createDataFrame([("abc", "abd", [3, 1, 2, 5]), (None, "", []), ("", "x", [1])], "a string, b string, xs array<int>")
    got = df.select(Q.char_ratio("a", "b").alias("r"), Q.increasing("xs").alias("i"), Q.opcodes(F.split("a", ""), F.split("b", "")).alias("o")).collect()
    assert [round(r.r, 4) for r in got] == [0.6667, 1.0, 0.0]
    assert [r.i for r in got] == [[1, 2, 5], [], [1]]
    assert got[0].o[0].tag == "equal"


def test_transplanted_runs(spark):
    df = spark.createDataFrame([(["a", "c"], ["a", "x", "y", "c", "z"], ["x", "y", "z"]), (["k", "k"], ["k", "x"], ["x"]), (["q"], ["x", "q"], ["x"]), (None, ["x"], ["x"])], "r array<string>, s array<string>, w array<string>")
    assert [r.o for r in df.select(Q.transplanted("r", "s", "w").alias("o")).collect()] == [["a", "x", "y", "c", "z"], ["k", "k"], ["x", "q"], []]


def test_long_sequences_in_linear_space():
    a = [str(i % 7) if i % 5 else str(i) for i in range(6000)]
    b = [x for i, x in enumerate(a) if i % 11] + ["end"]
    got = Q.matches(a, b)
    assert len(got) == len(b) - 1 and all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_line_functions(spark):
    one = lambda made, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} {'int' if isinstance(x, int) else 'string'}" for k, x in v.items())).select(made.alias("x")).first().x
    t, f = "a\nb\nc", F.col
    assert one(L.spliced(f("t"), f("i"), f("j"), f("n")), t=t, i=1, j=1, n="x\ny") == "a\nx\ny\nc"
    spans = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit("X\nY").alias("new")), F.struct(F.lit(2).alias("first"), F.lit(2).alias("last"), F.lit("Z").alias("new")))
    assert one(L.spliced_all(f("t"), spans), t=t) == "X\nY\nb\nZ"
    for result, ok in (("a\nnew\nc", True), ("a\nc", True), ("A\nb\nc", False), ("a\nb\nC", False), ("a", False)):
        assert one(L.outside_unchanged(f("t"), f("i"), f("j"), f("r")), t=t, i=1, j=1, r=result) is ok
    assert one(L.without_lines(f("t"), F.array(F.lit("b"))), t=t) == "a\nc" and one(L.without_lines(f("t"), F.array(F.lit("f("))), t="f(\n)") is None
    assert one(L.verbatim_copy(f("b"), f("c"), f("r"), f("x")), b="1", c="2", r="3", x=" 3 ") == "replayed" and one(L.verbatim_copy(f("b"), f("c"), f("r"), f("x")), b="1", c="1", r="3", x="3") is None
    assert tuple(spark.range(1).select(L.interleavings(F.lit(3), F.lit(2)), L.mean_surprise(F.array(F.lit(-1.0), F.lit(None), F.lit(-3.0)))).first()) == (10.0, 2.0)
    assert one(X.masked(f("t")), t="x = 'a b'  # note\ny = \"q\" // z") == "x = <STR> y = <STR>"


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(X.ident_tokens, "getUserName HTTPServer x1 the my_value 42") == ["get", "user", "name", "http", "server", "my", "value"]
    assert one(X.ident_tokens, None) == []
    assert one(X.fact, "  A  Claim.;: ") == "a claim"
    assert one(X.claim_kind, "MUST not retry") == "invariant"
    assert one(X.channel, "  #[cfg(x)]") == "directive" and one(X.channel, "# note") == "comment" and one(X.channel, "});") == "formatting" and one(X.channel, "x = 1") == "executable"
    assert one(X.anchor, "use crate::a::b;") == "crate::a::b" and one(X.anchor, "pub fn name(x)") == "name"
    assert one(X.has_markers, "a\n<<<<<<< x") and not one(X.has_markers, "a <<<<<<<")
    order = spark.createDataFrame([(v,) for v in ["1.10.0", "1.9.0", "1.10.0-rc1", "abc"]], "v string").orderBy(X.version_key(F.col("v")))
    assert [r.v for r in order.collect()] == ["abc", "1.9.0", "1.10.0-rc1", "1.10.0"]


def test_pooled_is_isotonic(spark):
    random.seed(3)
    rows = [(g, float(i), random.random() + i / 40) for g in range(2) for i in range(60)]
    got = S.pooled(spark.createDataFrame(rows, "g int, x double, y double"), "x", "y", keys=["g"]).orderBy("g", "x").collect()
    for g in range(2):
        y = np.array([r[2] for r in rows if r[0] == g])
        best = max_min(y)
        assert np.allclose([r.fitted for r in got if r.g == g], best)


def max_min(y):
    """The isotonic fit by its max-min formula."""
    n = len(y)
    mean = lambda a, b: y[a : b + 1].mean()
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_pooling_over_borders_of_ranges(spark, monkeypatch):
    """Groups over several ranges, hulls in several pieces: what rises, falls, repeats and grows fast; a null key, nulls, no rows."""
    monkeypatch.setattr(S, "PIECE", 8)
    shapes = {"rise": np.arange(120.0), "fall": -np.arange(120.0), "saw": np.arange(120) % 31 * 1.0, "fast": np.exp(np.arange(120) / 10), None: np.r_[np.arange(60.0), np.arange(60.0)], "one": np.array([3.0])}
    rows = [(k, float(i), float(y)) for k, v in shapes.items() for i, y in enumerate(v)] + [("one", None, 1.0), ("one", 5.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {(r.k, r.x): r.fitted for r in S.pooled(df, "x", "y", keys=["k"], each=1).collect()}
    assert len(got) == 601
    for k, v in shapes.items():
        assert np.allclose([got[k, float(i)] for i in range(len(v))], max_min(v), rtol=1e-9, atol=1e-9)
    assert S.pooled(df.limit(0), "x", "y", keys=["k"], each=1).count() == 0


def test_median_of_differences_that_are_not_formed(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v), first) for k, n, m in [("a", 70, 60), (None, 50, 50), ("b", 1, 200)] for first, c in [(True, n), (False, m)] for v in np.round(rng.normal(size=c) * 9, 1)]
    rows += [("a", 1e9, True), ("a", None, True), ("a", 1.0, None), ("a", float("nan"), False), ("alone", 1.0, True)]
    got = {r.k: r["shift"] for r in S.shift(spark.createDataFrame(rows, "k string, v double, f boolean"), ["k"], "v", F.col("f"), each=4).collect()}
    assert set(got) == {"a", "b", None}
    for k, found in got.items():
        x, y = ([v for a, v, f in rows if a == k and f is side and v == v and v is not None] for side in (True, False))
        assert np.isclose(found, np.median(np.subtract.outer(x, y)))


def test_logistic_fit_finds_the_weights(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = rng.random(4000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.7 * x[:, 1])))
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y boolean")
    w, bias = C.fit_logistic(df, ["a", "b"], "y")
    assert abs(w[0] - 1.5) < 0.2 and abs(w[1] + 0.7) < 0.2 and abs(bias) < 0.2
    assert C.fit_logistic(df.filter("y"), ["a"], "y") == ([0.0], 0.0)


def test_pooling_by_ranges_is_pooling(spark):
    """Many ranges, falling and rising runs, weights, ties."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 300, 2000).astype(float)
    y = np.sin(x / 30) + rng.normal(size=2000) / 4
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r.x: r.fitted for r in S.pooled(df, "x", "y").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    points = np.unique(x)
    w = np.array([(x == p).sum() for p in points], float)
    s = np.array([y[x == p].sum() for p in points])
    cs, cw = np.concatenate(([0], np.cumsum(s))), np.concatenate(([0], np.cumsum(w)))
    best = [max(min((cs[b + 1] - cs[a]) / (cw[b + 1] - cw[a]) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]
    assert np.allclose([got[p] for p in points], best)


def test_running_sums_and_what_is_built_on_them(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(12), i, rng.random() < 0.4) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, i int, f boolean")
    for k, v, _, n, total in S.running(df, ["k"], ["v"], {"n": F.lit(1)}).select("k", "v", "i", "n", "n_all").collect():
        assert n == sum(r[0] == k and r[1] <= v for r in rows) and total == sum(r[0] == k for r in rows)
    for r in S.quantiles(df, ["k"], "v", {"q": 0.3, "mid": 0.5}).collect():
        own = [x[1] for x in rows if x[0] == r.k]
        assert np.isclose(r.q, np.quantile(own, 0.3)) and np.isclose(r.mid, np.median(own))
    for r in S.shift(df, ["k"], "v", F.col("f")).collect():
        assert r["shift"] == np.median([p[1] - q[1] for p in rows for q in rows if p[0] == q[0] == r.k and p[3] and not q[3]])
    kept = S.trimmed(df, ["k"], "v", 0.1, "i").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in kept} == {k: (n := sum(x[0] == k for x in rows)) - 2 * int(n * 0.1) for k in ("a", "b", None)}
    assert S.running(df.limit(0), ["k"], ["v"], {"n": F.lit(1)}).count() == 0


def test_fit_is_read_between_and_beyond_its_points(spark):
    fit = spark.createDataFrame([("a", 1.0, 0.2), ("a", 3.0, 0.2), ("a", 5.0, 0.6), ("b", 2.0, 0.9)], "k string, x double, fitted double")
    asked = [("a", 0.0, 0.2), ("a", 2.0, 0.2), ("a", 4.0, 0.4), ("a", 5.0, 0.6), ("a", 9.0, 0.6), ("b", 7.0, 0.9), ("c", 1.0, 0.0), ("a", None, None)]
    got = S.evaluated(spark.createDataFrame(asked, "k string, x double, want double"), "x", fit, ["k"]).collect()
    assert len(got) == len(asked)
    for r in got:
        assert r.fitted is None if r.want is None else abs(r.fitted - r.want) < 1e-12


def test_models_are_saved_and_loaded(spark, tmp_path):
    scores = spark.createDataFrame([(0.1,), (0.5,), (0.5,), (0.9,)], "score double")
    C.save_model(spark, str(tmp_path / "c"), [1.0, -2.0], 0.5, ["a", "b"], scores, alpha=0.3, entropy_threshold=2.0)
    C.save_model(spark, str(tmp_path / "l"), [1.0], 0.0, ["a"], threshold=0.8)
    model = C.load_model(spark, str(tmp_path / "c"), conformal_only=True)
    assert (model["coefficients"], model["intercept"], model["alpha"], model["scores"].count()) == ([1.0, -2.0], 0.5, 0.3, 4)
    assert C.load_model(spark, str(tmp_path / "l"))["threshold"] == 0.8
    assert C.load_model(spark, str(tmp_path / "l"), conformal_only=True) is None and C.load_model(spark, str(tmp_path / "none")) is None
    spark.createDataFrame([("not json",)], "value string").write.text(str(tmp_path / "bad" / "model"))
    assert C.load_model(spark, str(tmp_path / "bad")) is None
    own = spark.createDataFrame([(1, 0.5), (2, 0.95), (3, 0.0)], "id int, s double")
    ranks = {r.id: r.p for r in C.conformal(own, model["scores"].withColumnRenamed("score", "s"), [], "id", "s").collect()}
    assert ranks == {1: 2 / 5, 2: 1 / 5, 3: 1.0}
    assert {r.id: r.p for r in C.conformal(own, own.limit(0), [], "id", "s").collect()} == {1: 0.5, 2: 0.95, 3: 0.0}
    e = spark.createDataFrame([(0.2, None), (0.4, 3.0), (0.4, 1.0), (None, None)], "p double, h double").select(C.escalates(F.col("p"), 0.3, F.col("h"), 2.0).alias("e")).collect()
    assert [r.e for r in e] == [True, True, False, False]


def test_half_trains_and_half_calibrates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = rng.random(400) < 1 / (1 + np.exp(-3 * x))
    df = spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x double, y boolean")
    w, bias, scores = C.fit_conformal(df, ["x"], "y", ["i"])
    plain, b0 = C.fit_logistic(df.filter("i < 200"), ["x"], "y")
    p = 1 / (1 + np.exp(-(plain[0] * x[200:] + b0)))
    assert np.allclose(w, plain) and np.allclose(sorted(r.score for r in scores.collect()), sorted(np.where(y[200:], 1 - p, p)))


def test_designs(spark):
    d = D.fractional_factorial(spark, list("abcdefgh")).collect()
    assert len(d) == 16
    m = np.array([[r[f] for f in "abcdefgh"] for r in d])
    assert (m.sum(axis=0) == 0).all() and (m.T @ m == 16 * np.eye(8)).all()
    assert len(D.fractional_factorial(spark, list("abcd")).collect()) == 8


def test_unions_decline(spark):
    row = spark.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in {"b": "xy", "c": "xyc", "r": "xyr", "e": "xzr", "s": "xyc"}.items()])
    got = row.select(*[M.list_union(F.col("b"), F.col("c"), F.col(k)).alias(k) for k in "rebs"]).first()
    assert got.r == list("xycr") and got.e is None and got.b == list("xyc") and got.s is None


def test_greedy_pairs(spark):
    from siltstone.operators.pairing import greedy

    rows = [(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.85), (2, 11, 0.1), (3, 12, 0.5), (4, 12, 0.5)]
    got = {(r.a, r.b) for r in greedy(spark.createDataFrame(rows, "a int, b int, s double"), "a", "b", "s").collect()}
    assert got == {(1, 10), (2, 11), (3, 12)}


def test_greedy_chains_and_ties_against_a_loop(spark, monkeypatch):
    """A falling chain of 60 pairs takes one round; random pairs with ties, repeats and nulls give what a loop does."""
    from siltstone.operators import pairing

    tables = []
    real = pairing.written
    monkeypatch.setattr(pairing, "written", lambda df, name: tables.append(name) or real(df, name))
    chain = [((i + 1) // 2, i // 2, 1 - i / 100) for i in range(60)]
    rng = random.Random(4)
    mixed = [(rng.randrange(15), rng.randrange(15), rng.randrange(4) / 4) for _ in range(80)]
    for rows in (chain, mixed + mixed[:5] + [(None, 1, 0.5), (1, None, 0.5), (2, 2, None)]):
        tables.clear()
        got = {(r.a, r.b) for r in pairing.greedy(spark.createDataFrame(rows, "a int, b int, s double"), "a", "b", "s").collect()}
        want, used = set(), set()
        for s, a, b in sorted((-s, a, b) for a, b, s in rows if None not in (a, b, s)):
            if ("a", a) not in used and ("b", b) not in used:
                want.add((a, b))
                used |= {("a", a), ("b", b)}
        assert got == want
        assert rows is not chain or (tables.count("won") == 1 and tables.count("chains") < 10)
    assert pairing.greedy(spark.createDataFrame([], "a int, b int, s double"), "a", "b", "s").count() == 0


def test_three_way_repairing(spark):
    from siltstone.operators.pairing import repaired

    make = lambda rows: spark.createDataFrame(rows, "kind string, name string, body string")
    base = [("f", "foo", "x"), ("f", "keep", "k"), ("f", "dup1", "d"), ("f", "dup2", "d"), ("f", "copy", "c"), ("f", "empty", ""), ("f", "both", "b"), ("g", "foo", None)]
    left = [("f", "bar", "x"), ("f", "keep", "k"), ("f", "n2", "d"), ("f", "n1", "d"), ("f", "copied", "c"), ("f", "none", ""), ("f", "l", "b"), ("f", "bar", "x")]
    right = [("f", "foo", "changed"), ("f", "keep", "k"), ("f", "copy", "c"), ("f", "r", "b"), ("g", "foo", None)]
    got = {tuple(r) for r in repaired(make(base), make(left), make(right)).collect()}
    assert got == {("f", "foo", "bar", "foo"), ("f", "dup1", "n1", None), ("f", "dup2", "n2", None), ("f", "both", "l", "r")}
    assert repaired(make(base).limit(0), make(left), make(right)).count() == 0


def test_renames_of_copies_take_few_rounds(spark, monkeypatch):
    """Many names with the same words, on uneven sides and in classes that tie: as by a loop, in few rounds."""
    from siltstone.operators import pairing

    rng = random.Random(10)
    sets = [["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "f"], ["a", "b", "c", "d", "g"], ["p", "q", "r"], ["p", "q", "s"], ["u", "v"]]
    rows = lambda side, n: [("k", f"{side}{i:03}", f"{side}{i}", sets[rng.randrange(6)]) for i in range(n)]
    old, new = rows("o", 120), rows("n", 90)
    old += [("k", f"x{i:03}", f"x{i}", ["y", "z", "t"]) for i in range(40)]  # classes without ties
    new += [("k", f"x{i + 50:03}", f"y{i}", ["z", "y", "t", "w"]) for i in range(30)]
    tables, real = [], pairing.written
    monkeypatch.setattr(pairing, "written", lambda df, name: tables.append(name) or real(df, name))
    shape = lambda x: spark.createDataFrame(x, "kind string, name string, body string, words array<string>")
    got = {(r.old_name, r.new_name, r.how) for r in pairing.renames(shape(old), shape(new), 0.5).collect()}
    near = [(-round(len(set(x[3]) & set(y[3])) / len(set(x[3]) | set(y[3])), 9), x[1], y[1]) for x in old for y in new]
    want, used = set(), set()
    for s, a, b in sorted(n for n in near if n[0] <= -0.5):
        if a not in used and b not in used:
            want.add((a, b, "like_body"))
            used |= {a, b}
    assert got == want and len(want) > 100
    assert len(tables) <= 60, len(tables)


def test_renames_against_brute_force(spark):
    from siltstone.operators.pairing import renames

    rng = random.Random(9)
    body = lambda: [f"w{rng.randrange(60)}" for _ in range(12)]
    old = [("k" + str(i % 2), f"o{i:02}", body()) for i in range(40)]
    new = []
    for k, n, w in old:
        u = rng.random()
        if u < 0.3:
            new.append((k, n, w))
        elif u < 0.6:
            new.append((k, "n" + n, w))
        elif u < 0.9:
            new.append((k, "m" + n, w[1:] + [f"w{rng.randrange(60)}"]))
    shape = lambda rows: spark.createDataFrame([(k, n, " ".join(w), sorted(set(w))) for k, n, w in rows], "kind string, name string, body string, words array<string>")
    got = {(r.kind, r.old_name, r.new_name, r.how) for r in renames(shape(old), shape(new)).collect()}
    gone = [x for x in old if (x[0], x[1]) not in {y[:2] for y in new}]
    come = [y for y in new if (y[0], y[1]) not in {x[:2] for x in old}]
    want, used = set(), set()
    for x in sorted(gone):
        for y in sorted(come):
            if y[0] == x[0] and y[2] == x[2] and y[:2] not in used and x[:2] not in used:
                want.add((x[0], x[1], y[1], "equal_body"))
                used |= {x[:2], y[:2]}
    near = []
    for x in gone:
        for y in come:
            a, b = set(x[2]), set(y[2])
            j = round(len(a & b) / len(a | b), 9)
            if x[0] == y[0] and x[:2] not in used and y[:2] not in used and j >= 0.6:
                near.append((-j, x[0], x[1], y[1]))
    for _, k, o, n in sorted(near):
        if (k, o) not in used and (k, n) not in used:
            want.add((k, o, n, "like_body"))
            used |= {(k, o), (k, n)}
    assert got == want


def test_robust_fit_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.arange(40.0)
    y = x / 10 + rng.normal(0, 0.1, 40)
    y[20] = 30.0
    got = S.pooled_robust(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), "x", "y").orderBy("x")

    def pav(w):
        blocks = []
        for a, b in zip(y, w, strict=True):
            blocks.append([a * b, b, 1])
            while len(blocks) > 1 and blocks[-1][0] / blocks[-1][1] < blocks[-2][0] / blocks[-2][1] - 1e-12:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
        return np.array([s / n for s, n, k in blocks for _ in range(k)])

    w, cut = np.ones(40), None
    for _ in range(10):
        r = y - pav(w)
        if cut is None:
            cut = 1.345 * 1.4826 * np.median(np.abs(r - np.median(r)))
        new = np.minimum(1, cut / (np.abs(r) + 1e-12))
        done = np.abs(new - w).max() < 1e-4
        w = new
        if done:
            break
    assert np.allclose([r.fitted for r in got.collect()], pav(w), atol=1e-9)
