import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from siltstone.operators import decisions as D
from siltstone.operators import lineage as G
from siltstone.operators import reuse as R
from siltstone.operators import unions as U
from siltstone.sources import sinks as S


def woven(base, x, y):
    """Plain walk over the base, from the runs before each of its lines."""

    def runs(side):
        out, i = {}, 0
        for line in side:
            if i < len(base) and line == base[i]:
                i += 1
            else:
                out.setdefault(i, []).append(line)
        return out if i == len(base) else None

    p, q = runs(x), runs(y)
    if p is None or q is None:
        return "edited", None
    flat = lambda r: {line for run in r.values() for line in run if line.strip()}
    if flat(p) & flat(q):
        return "shared", None
    return "inserted", [line for i in range(len(base) + 1) for line in p.get(i, []) + q.get(i, []) + base[i : i + 1]]


def test_insertions_are_a_plain_walk(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(60):
        base = [f"b{i}" for i in range(rng.randint(0, 6))]

        def side(names, base=base):
            out = list(base)
            for _ in range(rng.randint(0, 4)):
                out.insert(rng.randint(0, len(out)), rng.choice(names))
            if base and rng.random() < 0.15:
                out.remove(rng.choice(base))
            return out

        cases.append((len(cases), base, side(["x", "y", "", "s"]), side(["u", "v", " ", "s"])))
    got = U.insertion_union(spark.createDataFrame(cases, "id int, base array<string>, current array<string>, replayed array<string>")).collect()
    want = {i: woven(b, c, r) for i, b, c, r in cases}
    assert {r.id: (r.reason, r.merged) for r in got} == want
    assert {w for w, _ in want.values()} == {"edited", "shared", "inserted"}


def test_insertions_of_nothing_and_directives(spark):
    rows = [(1, None, ["a"], None), (2, ["b"], ["b"], ["b"]), (3, ["b"], ["#p", "#q", "b"], ["b", "#q", "#r"]), (4, ["b"], ["#p", "b", "t"], ["#p", "b"]), (5, ["b", "b"], ["b", "b", "b"], ["b"])]
    df = spark.createDataFrame(rows, "id int, base array<string>, current array<string>, replayed array<string>")
    got = {r.id: (r.reason, r.merged) for r in U.insertion_union(df, directive="^#").collect()}
    assert got == {1: ("inserted", ["a"]), 2: ("inserted", ["b"]), 3: ("directives", ["#p", "#q", "#r", "b"]), 4: ("shared", None), 5: ("edited", None)}
    assert U.insertion_union(df.limit(0)).count() == 0


def test_lists_in_lines(spark):
    rows = [
        (1, ["#[derive(A, B)]", "x"], ["#[derive(B, C, C)]", "  #[derive(D)]"]),
        (2, ["  #[derive()]"], ["#[derive(A)]", "#[cfg(x)]"]),
        (3, ["#[derive(A)]", "#[derive(B)]"], ["#[derive(C)]", "no list", None]),
        (4, None, ["#[derive(C)]"]),
        (5, ["#[derive(A)]", None], None),
    ]
    df = spark.createDataFrame(rows, "id int, lines array<string>, missing array<string>")
    got = {r.id: (r.u.lines, len(r.u.closed), len(r.u.left)) for r in df.select("id", U.list_line_union(F.col("lines"), F.col("missing"), names=("derive",)).alias("u")).collect()}
    assert got == {1: (["#[derive(A, B, C, D)]", "x"], 2, 0), 2: (["  #[derive(A)]"], 1, 1), 3: (["#[derive(A)]", "#[derive(B)]"], 0, 3), 4: ([], 0, 1), 5: (["#[derive(A)]", None], 0, 0)}
    one = spark.range(1).select(U.list_line_union(F.array(F.lit('members = ["a"]')), F.array(F.lit('members = ["b", "a"]'), F.lit("version = 2")), U.SETTING).alias("u")).first().u
    assert (one.lines, one.left) == (['members = ["a", "b"]'], ["version = 2"])
    x = spark.range(1).select(U.listed(F.lit("#[allow(a,b , a)]")).alias("x"), U.listed(F.lit("none")).alias("y")).first()
    assert (x.x.name, x.x.entries, x.y.name, x.y.entries) == ("allow", ["a", "b"], "", [])


def test_keyed_items(spark):
    kind = "scope int, container string, name string, kind string, body string"
    frame = lambda *rows: spark.createDataFrame(list(rows), kind)
    base = frame((1, "c", "old", "fn", "1"))
    result = frame((1, "c", "old", "fn", "1"), (1, "d", "taken", "fn", "2"), (None, None, "z", None, "9"))
    other = frame(
        (1, "c", "old", "fn", "changed"), (1, "c", "new", "fn", "3"), (1, "c", "new", "fn", "3"), (1, "c", "taken", "fn", "4"), (1, "e", "far", "fn", "5"), (2, "c", "far", "fn", "5"),
        (1, "c", "twin", "fn", "6"), (1, "c", "twin", "fn", "7"), (1, "c", "lone", "fn", "6"), (1, "c", "lone", "macro", "7"), (1, "c", None, "fn", "8"), (None, None, "y", None, None),
    )
    got = sorted((r.scope or 0, r.name, r.body or "", r.outcome) for r in U.keyed_union(result, base, other, ["scope"], ("macro",)).collect())
    assert got == [(0, "y", "", "added"), (1, "far", "5", "no_container"), (1, "lone", "6", "added"), (1, "lone", "7", "excluded"), (1, "new", "3", "added"), (1, "taken", "4", "present"), (1, "twin", "6", "collision"), (1, "twin", "7", "collision"), (2, "far", "5", "no_container")]
    assert U.keyed_union(result, base, other.limit(0), ["scope"]).count() == 0
    assert {r.outcome for r in U.keyed_union(result.limit(0), base.limit(0), other, ["scope"]).collect()} == {"no_container"}


def test_first_reuse_is_a_plain_scan(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    store = [(i, pick("s", "t", "", None), pick("a", "b", "", None), pick("k", "l"), pick("p", "q", ""), pick(True, True, False, None), pick("r", "r", "", None)) for i in range(60)]
    asked = [(i, *row) for i, row in enumerate(product(["s", "t", "u", "", None], ["a", "c", ""], ["k", None], ["p", ""]))]
    got = R.first_reuse(spark.createDataFrame(asked, "id int, shape string, language string, kind string, path string"), spark.createDataFrame(store, "pos int, shape string, language string, kind string, path string, evidence boolean, resolved string"))
    want = {}
    for i, shape, *keys in asked:
        seen, found, any_ = [], None, False
        for pos, s, *theirs, evidence, resolved in store:
            if not shape or s != shape:
                continue
            any_ = True
            why = next((n for n, a, b in zip(("language", "kind", "path"), keys, theirs, strict=True) if a and b and a != b), None) or ("evidence" if not evidence else "resolved" if not resolved else None)
            if why is None:
                found = pos
                break
            if why not in seen:
                seen.append(why)
        if any_:
            want[i] = (found, seen)
    assert {r.id: (r.pos, r.near_misses) for r in got.collect()} == want


def test_history_features_with_one_history(spark):
    rng = random.Random(1)
    rows = [("h", rng.randint(1, 40), rng.choice(["a", "b", None]), rng.randint(0, 2)) for _ in range(150)] + [(None, 1, "a", 0), ("h", None, "a", 0)]
    got = G.history_features(spark.createDataFrame(rows, "history string, place int, path string, region int")).collect()
    key = lambda p: -1 if p is None else p
    assert len(got) == len(set(rows))
    for r in got:
        own = {(key(p), q, g) for h, p, q, g in rows if h == r.history}
        at = key(r.place)
        places = {p for p, _, _ in own}
        file = {p for p, q, _ in own if q == r.path}
        region = {p for p, q, g in own if q == r.path and g == r.region}
        assert (r.commit_index, r.commit_count) == (sum(p < at for p in places), len(places))
        assert (r.future_file_touches, r.future_region_touches, r.recent_file_touches) == (sum(p > at for p in file), sum(p > at for p in region), sum(p < at for p in file))


@pytest.mark.parametrize(("factor", "budget"), [(1.0, 2), (1.9, 3), (5.0, 4), (0.1, 1), (None, 2), (-3.0, 1)])
def test_role_budget(spark, factor, budget):
    assert spark.range(1).select(D.role_budget(2, F.lit(factor).cast("double")).alias("x")).first().x == budget


def test_refined_sides(spark):
    df = spark.createDataFrame([("a", "", "c"), ("a", None, "c")], "c string, b string, r string")
    assert [r.x and tuple(r.x) for r in df.select(R.refined(F.col("c"), F.col("b"), F.col("r")).alias("x")).collect()] == [("a", "", "c"), None]


def test_numbers_of_equal_events(spark):
    events = spark.createDataFrame([("s", 1, "a")] * 3 + [("s", 0, "b"), (None, 5, "c"), ("s", None, "d")], "session_id string, timestamp int, event_type string")
    got = sorted((r.session_id or "", r.seq, r.event_type) for r in S.numbered(events).collect())
    assert got == [("", 1, "c"), ("s", 1, "d"), ("s", 2, "b"), ("s", 3, "a"), ("s", 4, "a"), ("s", 5, "a")]
