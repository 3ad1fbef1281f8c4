"""Every registered query of the library against its SQL, on the smallest tables."""

import os
import re

import duckdb
import numpy as np
import pytest

from siltstone.functions import sequences as Q
from siltstone.plans import registry

registry.load()
DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(frame):
    def plain(x):
        if x is None or x != x:
            return "null"
        return f"{x:.7g}" if isinstance(x, float) else str(x)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_is_its_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, DIR).toPandas()
    theirs = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def common(a, b):
    """Length of a longest common subsequence, from the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_name_similarity(spark, duck):
    names = duck.execute("SELECT p_partkey, p_name, lower(p_type) FROM part").fetchall()
    want = {k: round(2 * common(a, b) / (len(a) + len(b)), 6) for k, a, b in names}
    assert {r.p_partkey: r.similarity for r in registry.QUERIES["name_similarity"](spark, DIR).collect()} == want


def test_line_edits(spark, duck):
    turns = duck.execute("SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) FROM conversations").fetchall()
    words = lambda x: re.split(r"\s+", x)
    got = {(r.conv_id, r.turn): r for r in registry.QUERIES["line_edits"](spark, DIR).collect()}
    assert set(got) == {(c, t) for c, t, _, b in turns if b is not None}
    for c, t, a, b in turns:
        if b is not None:
            runs = Q.edit_runs(words(a), words(b))
            assert sum(r["i2"] - r["i1"] for r in runs if r["tag"] == "equal") == common(words(a), words(b))
            assert sum(r["tag"] == "equal" for r in runs) == got[c, t].n_equal and sum(r["tag"] == "replace" for r in runs) == got[c, t].n_replace


def test_logistic_fit(spark, duck):
    rows = np.array(duck.execute("SELECT ln(1 + n_chars), (lang = 'en')::INT, 1, quality FROM documents JOIN labels USING (doc_id)").fetchall(), float)
    x, y = rows[:, :3], rows[:, 3]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = np.zeros(3)
    for _ in range(8):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), x.T @ (w * (y - p)) - 1e-3 * beta)
    got = {r.feature: r.weight for r in registry.QUERIES["logistic_fit"](spark, DIR).collect()}
    assert np.allclose([got[k] for k in ("size", "english", "bias")], beta, atol=2e-4)


def test_robust_isotonic_quality(spark, duck):
    rows = np.array(duck.execute("SELECT floor(n_chars / 50), quality FROM documents JOIN labels USING (doc_id)").fetchall(), float)
    x, y, w, cut = rows[:, 0], rows[:, 1], np.ones(len(rows)), None
    points = np.unique(x)

    def fit():
        s, n = (np.concatenate(([0], np.cumsum([(v[x == p]).sum() for p in points]))) for v in (w * y, w))
        return {p: max(min((s[b + 1] - s[a]) / (n[b + 1] - n[a]) for b in range(i, len(points))) for a in range(i + 1)) for i, p in enumerate(points)}

    for _ in range(10):
        now = fit()
        r = y - np.array([now[p] for p in x])
        cut = cut or 1.345 * 1.4826 * np.median(np.abs(r - np.median(r))) or 1.345
        new = np.minimum(1, cut / (np.abs(r) + 1e-12))
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-4:
            break
    now = fit()
    for row in registry.QUERIES["robust_isotonic_quality"](spark, DIR).collect():
        assert abs(row.fitted - now[row.x]) < 2e-4


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert os.path.isdir(DIR)
