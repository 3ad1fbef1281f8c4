import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import changes as C
from siltstone.plans import registry

NAMED = "kind string, name string, signature string, body string"
ACTION = "scope int, item string, operation string, text string"
ITEM = "scope int, item string, class string, text string"
ENTRY = "scope int, lineage string, version string, text string, anchor string, start int, stop int"


def test_change_classes(spark):
    old = spark.createDataFrame([("f", "same", "s", "b"), ("f", "sig", "s", "b"), ("f", "body", "s", "b"), ("f", "gone", "s", "b"), ("f", "was", "s", "b"), (None, "x", None, None)], NAMED)
    new = spark.createDataFrame([("f", "same", "s", "b"), ("f", "sig", "t", "c"), ("f", "body", "s", None), ("g", "gone", "s", "b"), ("f", "is", "s", "b")], NAMED)
    moved = spark.createDataFrame([("f", "was", "is")], "kind string, old_name string, new_name string")
    got = {tuple(r) for r in C.change_classes(old, new, moved).collect()}
    assert got == {("f", "sig", None, "signature_changed"), ("f", "body", None, "body_changed"), ("f", "gone", None, "removed"), ("g", "gone", None, "added"), ("f", "is", "was", "renamed"), (None, "x", None, "removed")}
    assert C.change_classes(old.limit(0), new.limit(0), moved).count() == 0
    assert {r.change for r in C.change_classes(old.limit(0), new, moved.limit(0)).collect()} == {"added"}


def test_matched_in_turn(spark):
    kind = "kind string, name string, id int, body string, words array<string>, vec array<double>, up boolean"
    sources = [("k", "a", 1, "x y", ["x", "y"], [1.0, 0.0], True), ("k", "b2", 2, "p q r", ["p", "q", "r"], [0.0, 1.0], True), ("k", "c2", 3, "u", ["u"], [0.6, 0.8], True), ("k", "d2", 4, "v", ["v"], [-1.0, 0.0], True), ("k", "e2", 5, "w", ["w"], None, None), ("k", "f2", 6, "z", ["z"], [-0.7, -0.72], True)]
    targets = [("k", "a", 11, "other", ["other"], [0.0, -1.0], True), ("k", "b1", 12, "p q r", ["p", "q", "r"], [0.6, 0.8], True), ("k", "c1", 13, "m", ["m"], [0.58, 0.81], False), ("k", "d1", 14, "n", ["n"], [-0.75, 0.66], True), ("j", "e1", 15, "w", ["w"], [1.0, 1.0], True)]
    got = C.matched_in_turn(spark.createDataFrame(sources, kind), spark.createDataFrame(targets, kind), F.expr("a.up AND b.up")).collect()
    assert {(r.name, r.target, r.how) for r in got} == {("a", "a", "same_name"), ("b2", "b1", "renamed"), ("c2", "c1", "renamed"), ("d2", "d1", "possibly_renamed"), ("e2", None, "unmatched"), ("f2", None, "unmatched")}
    assert {r.how for r in C.matched_in_turn(spark.createDataFrame(sources, kind), spark.createDataFrame([], kind)).collect()} == {"unmatched"}


def test_matched_in_turn_query(spark):
    """The query against plain loops: names, then bodies, then vectors in order of id."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    even, odd = [r for r in rows if r.vec_id % 2 == 0], [r for r in rows if r.vec_id % 2]
    unit = lambda v: np.array(v, float) / np.linalg.norm(np.array(v, float))
    kind = {r.vec_id: r.label for r in rows}
    want, used, left = {}, set(), []
    for r in even:
        half, twin = r.vec_id // 2, r.vec_id + 1
        if twin in kind and kind[twin] == r.label and half % 3 < 2:
            want[r.label, half] = (half, "same_name") if half % 3 == 0 else (-1 - half, "renamed")
            used.add(twin)
        else:
            left.append(r)
    free = [r for r in odd if r.vec_id not in used and not (r.vec_id // 2 % 3 == 0 and (r.label, r.vec_id // 2) in {(x.label, x.vec_id // 2) for x in even})]
    for r in left:
        near = sorted((-float(unit(r.embedding) @ unit(f.embedding)), f.vec_id) for f in free if f.label == r.label)
        if near and -near[0][0] >= 0.4:
            hit = next(f for f in free if f.vec_id == near[0][1])
            free.remove(hit)
            want[r.label, r.vec_id // 2] = (hit.vec_id // 2 if hit.vec_id // 2 % 3 == 0 else -1 - hit.vec_id // 2, "renamed")
        else:
            want[r.label, r.vec_id // 2] = (None, "unmatched")
    registry.load()
    got = {(r.kind, r.name): (r.target, r.how) for r in registry.QUERIES["matched_in_turn"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_plan_failures(spark):
    items = spark.createDataFrame([(1, "a", "prose", "short one"), (1, "a", "prose", "shorter"), (1, "b", "legal", "x" * 200), (1, "c", None, None), (1, None, "prose", "n"), (2, "a", "prose", "of two")], ITEM)
    actions = spark.createDataFrame(
        [(1, "a", "rewrite", "call RetryCount or retry_count, MAX_SIZE, TIMEOUT, http2, Plain and NOW"), (1, "b", "delete", None), (1, "b", "keep", "y # z"), (1, "zz", "keep", ""), (1, "", "keep", ""), (1, None, "merge", "# fine text"), (2, "a", "move", "RetryCount, a long way // off")],
        ACTION,
    )
    names = spark.createDataFrame([(1, "TIMEOUT"), (1, "TIMEOUT"), (1, None)], "scope int, name string")
    got = {(r.scope, r.item, r.check): r.n for r in C.plan_failures(actions, items, names, ("legal",)).collect()}
    assert got == {(1, "a", "stale_identifier"): 3, (1, "a", "style"): 1, (1, "b", "directive_changed"): 1, (1, "b", "duplicate"): 2, (1, "c", "unaccounted"): 0, (1, "zz", "invalid_anchor"): 1, (1, None, "style"): 1, (2, "a", "style"): 1}
    assert C.plan_failures(actions.limit(0), items.limit(0), names).count() == 0


def test_dispositions(spark):
    three = lambda lineage, texts, lo=0, hi=2, anchor="": [(1, lineage, v, t, anchor, lo, hi) for v, t in zip(("base", "current", "replayed"), texts, strict=True)]
    rows = [
        *three("same", ["t", " t ", "t"]), *three("case", ["t  u", "T u", "t\nu"]), *three("new", ["t", "u", "t"]), *three("met", ["t", "t", "t"], 10, 12), *three("near", ["t", "t", "t"], 6, 10),
        *three("lost", ["t", "t", "t"], anchor="f"), *three("kept", ["t", "t", "t"], anchor="g"), (1, "other", "resolved", "t", "g", 0, 1), (1, "part", "base", "t", None, 0, 1), (1, "alive", "base", "t", "f", 0, 1), (1, "alive", "resolved", "t", None, 0, 1),
        (1, "bare", "resolved", None, None, None, None), (None, "n", "base", "t", "g", 0, 1),
    ]
    spans = spark.createDataFrame([(1, 10, 11), (1, 3, 3), (2, 0, 9), (1, None, None)], "scope int, start int, stop int")
    got = {r.lineage: r.disposition for r in C.dispositions(spark.createDataFrame(rows, ENTRY), spans).collect()}
    assert got == {"same": "unchanged", "case": "cosmetic", "new": "frontier", "met": "frontier", "near": "unchanged", "lost": "delete", "kept": "unchanged", "other": "unchanged", "part": "frontier", "alive": "frontier", "bare": "unchanged", "n": "delete"}
    assert C.dispositions(spark.createDataFrame([], ENTRY), spans).count() == 0
