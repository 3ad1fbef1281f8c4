import json
import random
import re

import duckdb
from pyspark.sql import functions as F

from siltstone.operators import tokens as T

ODD = [None, "", " ", "a_b9 \n\t--x", "é_é  日本 12,5", "\\{\"}", "__1__", "a" * 70_000, "x\r\ny z"]


def test_tokens_are_the_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").select("i", T.tokens(F.col("t")).alias("x")).collect()
    for r in rows:
        assert "".join(r.x) == (ODD[r.i] or "") and all(r.x)
        assert all(re.fullmatch(r"[A-Za-z_]+|[0-9]+|\s+|[^\sA-Za-z0-9]+", x) for x in r.x)


def plain_merge(base, current, replayed):
    """By single tokens and gaps: a merge exists if no token and no gap is touched from both sides."""
    from tests.unit.test_versions import plain_alignment

    cut = lambda t: re.findall(T.TOKENS, t)
    b, sides = cut(base), []
    for side in (cut(current), cut(replayed)):
        pairs = [(-1, -1), *plain_alignment(b, side), (len(b), len(side))]
        sides.append([(i + 1, k, "".join(side[j + 1 : m])) for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False) if k - i > 1 or m - j > 1])
    x, y = sides
    if not x or not y:
        return "unchanged", None
    touched = [({n for lo, hi, _ in s for n in range(lo, hi)}, {lo for lo, hi, _ in s if lo == hi}) for s in sides]
    (sx, px), (sy, py) = touched
    if sx & sy or sx & py or sy & px or px & py:
        return "overlap", None
    out, at = "", 0
    for lo, hi, new in sorted(x + y):
        out += "".join(b[at:lo]) + new
        at = hi
    return "merged", out + "".join(b[at:])


def test_token_merge(spark):
    r = random.Random(9)
    data = []
    for _ in range(300):
        base = [r.choice(["let", "x", "=", "1", "+", "y", ";"]) for _ in range(r.randint(0, 8))]
        sides = []
        for _ in range(2):
            s = list(base)
            for _ in range(r.randint(0, 2)):
                at = r.randint(0, len(s))
                s[at : at + r.randint(0, 2)] = r.choice([[], ["z"], ["2", "w"]])
            sides.append(" ".join(s))
        data.append((" ".join(base), *sides))
    data += [(None, "a", "b"), (None, None, None), ("a\n" * 5, "a\n" * 5 + "b", "c\n" + "a\n" * 5), ("a b c", "x b c", "a b y")]
    rows = spark.createDataFrame([(i, *d, "own") for i, d in enumerate(data)], "i int, base string, current string, replayed string, text string")
    got = T.token_merge(rows).collect()
    assert len(got) == len(data) and {g.text for g in got} == {"own"}
    kinds = set()
    for g in got:
        texts = [t or "" for t in data[g.i]]
        want = ("large", None) if sum(bool(x.strip()) for t in texts for x in t.splitlines()) > 12 else plain_merge(*texts)
        assert (g.reason, g.merged) == want
        kinds.add(g.reason)
    assert kinds == {"large", "merged", "overlap", "unchanged"}
    assert T.token_merge(rows.limit(0)).count() == 0


def plain_objects(text):
    out, depth, quoted, skip = [], 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, skip = skip or c != '"', not skip and c == "\\"
        elif c == '"':
            quoted, skip = True, False
        elif c == "{":
            first = i if depth == 0 else first
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[first : i + 1])
    return out


def test_balanced_objects(spark):
    r = random.Random(10)
    texts = ["".join(r.choice('{}"\\a\n é') for _ in range(r.randint(0, 30))) for _ in range(800)] + ["", "{" * 500 + "}" * 500, '{"a": "}"} {"b": {"c": "\\"}"}}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for row in rows.select("i", T.balanced_objects(F.col("t")).alias("x")).collect():
        assert row.x == (plain_objects(texts[row.i]) if row.i < len(texts) else []), texts[row.i]


def test_tiers(spark):
    one, two = '{"a": {"b": [1, 2]}}', '{"c": "x } y"}'
    cases = [
        (f"\n {one} ", "direct", one),
        (f"so\n```json\n{one}\n```\n{two}", "fenced", one),
        (f"```\n{one}\n```\n```\nno\n```", "fenced", one),
        (f"first {one}, then {two}.", "balanced", two),
        ('it is {"a": [1, 2,],}', "balanced", '{"a": [1, 2]}'),
        ("[1, 2]", "none", None),
        ("{broken", "none", None),
        ("{'a': 1 2}", "none", None),
        ("", "none", None),
        (None, "none", None),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", T.extracted_object(F.col("t")).alias("x"))
    for row in rows.collect():
        assert (row.x.tier, row.x.object) == cases[row.i][1:]
        assert row.x.object is None or isinstance(json.loads(row.x.object), dict)


def plain_edits(text, edits):
    text, failed = text or "", []
    flat = lambda s: " ".join(s.split())
    for i, e in enumerate(edits):
        search, new = (e or (None, None))
        search, new = (search or "").rstrip("\n"), new or ""
        if not search:
            failed.append((i, "empty"))
        elif flat(search) == flat(new):
            failed.append((i, "same"))
        else:
            spans = [(at, at + len(search)) for at in [text.find(search)] if at >= 0]
            if not spans and flat(search):  # every span of the text that is the search but for white space, the first and shortest
                spans = [(a, b) for a in range(len(text)) if not text[a].isspace() for b in range(a + 1, len(text) + 1) if not text[b - 1].isspace() and flat(text[a:b]) == flat(search)]
            if spans:
                text = text[: spans[0][0]] + new + text[spans[0][1] :]
            else:
                failed.append((i, "missing"))
    return text, failed


def test_edits_in_order(spark):
    r = random.Random(11)
    piece = lambda n: "".join(r.choice(["a", "b", " ", "  ", "\n", ".", "\\E", "$1"]) for _ in range(r.randint(0, n)))
    data = [(i, piece(14), [r.choice([(piece(4), piece(3))] * 8 + [None, (None, "x"), ("a", None)]) for _ in range(r.randint(0, 4))]) for i in range(400)] + [(400, None, [("a", "b")]), (401, "a b", None)]
    rows = spark.createDataFrame(data, "i int, text string, edits array<struct<search:string,replace:string>>")
    for row in rows.select("i", T.applied_edits(F.col("text"), F.col("edits")).alias("x")).collect():
        want = plain_edits(data[row.i][1], data[row.i][2] or [])
        assert (row.x.text, [tuple(f) for f in row.x.failed]) == want, data[row.i]


def test_edits_in_order_query_on_odd_turns(spark, tmp_path):
    """The query equals its SQL where a turn's words are what the edits write."""
    from siltstone.plans import registry

    registry.load()
    texts = ["X nas asja kus Y ja de es", "a b c d Y f g h", "Y b c d X f g h", "a X Y b c d e f", "a b c d y f g h", "a b! c d e! f g h", "a ab abc b ba bab A B", "a b c d Y f g", "Y Y c d e f g h", "", None]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(i, 1, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(path)
    got = registry.QUERIES["edits_in_order"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(registry.ORACLE_SQL["edits_in_order"]).fetchall()
    assert len(want) == 7 and sorted(tuple(r) for r in got) == sorted(want)
