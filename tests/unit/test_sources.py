import json

import pytest
from pyspark.sql import functions as F

from siltstone.sources import histories as H
from siltstone.sources import readers as R
from siltstone.sources import sinks as S


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_outcomes_skip_broken_lines_and_fill_defaults(spark, tmp_path):
    lines = ['{"example": {"base": "a", "resolved": "b"}, "outcome": "accepted", "retry_count": 2}', "{broken", '{"outcome": "accepted"}', '{"example": {"base": "x"}}']
    got = R.outcomes(spark, write(tmp_path / "log.jsonl", "\n".join(lines)))
    assert [(r.example.base, r.outcome, r.retry_count, r.risk_score) for r in got.orderBy("example.base").collect()] == [("a", "accepted", 2, 0.0), ("x", "", 0, 0.0)]
    assert got.select("outcome").count() == 2


def test_journal_is_strict(spark, tmp_path):
    good = '{"seq": 1, "session_id": "s", "event_type": "a", "payload": "{}"}'
    assert R.journal(spark, write(tmp_path / "a.jsonl", good)).first().seq == 1
    with pytest.raises(Exception):
        R.journal(spark, write(tmp_path / "b.jsonl", good + "\n{oops")).collect()


def test_sessions_cases_and_versions(spark, tmp_path):
    write(tmp_path / "s/one/a.jsonl", "{}")
    write(tmp_path / "s/one/b.jsonl", "{}")
    write(tmp_path / "s/two/a.jsonl", "{}\n")
    assert {(r.session_id, r.n_files, r.bytes) for r in R.sessions(spark, str(tmp_path / "s")).collect()} == {("one", 2, 4), ("two", 1, 3)}
    write(tmp_path / "c/1.json", json.dumps({"id": "1", "language": "python"}, indent=1))
    write(tmp_path / "c/2.json", json.dumps({"id": "2", "language": "rust"}))
    assert [r.id for r in R.cases(spark, str(tmp_path / "c"), "id string, language string", language="rust").collect()] == ["2"]
    for role in "OAB":
        write(tmp_path / f"v/case1/{role}.txt", role.lower() * 2)
    r = R.versions(spark, str(tmp_path / "v")).first()
    assert (r.case, r.base, r.current, r.replayed, r.merged) == ("case1", "oo", "aa", "bb", None)


def test_marker_blocks(spark):
    text = "x\n<<<<<<< ours\na\nb\n||||||| base\nc\n=======\nd\n>>>>>>> theirs\ny\n<<<<<<< ours\nopen"
    got = R.marker_blocks(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id int, text string"), "id", "text").collect()
    assert [(r.id, r.block, r.first_line, r.last_line, r.current, r.base, r.replayed) for r in got] == [(1, 1, 1, 8, "a\nb", "c", "d")]


def test_tool_output(spark):
    lines = spark.createDataFrame([('{"reason": "compiler-message", "message": {"level": "error", "message": "bad", "code": {"code": "E1"}, "spans": [{"file_name": "a.rs", "line_start": 3, "is_primary": true}]}}',), ('{"reason": "other"}',), ("src/a.rs:4:2: error: worse",)], "value string")
    d = R.diagnostics(lines).collect()
    assert [(r.level, r.code, r.message, r.file, r.line) for r in d] == [("error", "E1", "bad", "a.rs", 3)]
    assert [(r.file, r.line, r.message) for r in R.text_diagnostics(lines).collect()] == [("src/a.rs", 4, "worse")]
    out = spark.createDataFrame([("tests/a.py::t1 PASSED\ntests/a.py::t2 FAILED\ntest m::x ... ok\n--- PASS: TestY (0.0s)",)], "value string")
    assert {r.test for r in R.passing_tests(out).collect()} == {"tests/a.py::t1", "m::x", "TestY"}
    runs = spark.createDataFrame([(True, 0, "", ""), (False, 0, "5 passed", ""), (False, 1, "1 failed", ""), (False, 127, "", "pytest: command not found"), (False, 1, "", "error: no")], "t boolean, c int, o string, e string")
    assert [r.v for r in runs.select(R.test_verdict(F.col("t"), F.col("c"), F.col("o"), F.col("e")).alias("v")).collect()] == ["timeout", "passed", "failed", "tool_missing", "build_failed"]
    listing = spark.createDataFrame([("100644 aa 1\ta b\x00100644 bb 2\ta b\x00100644 cc 3\tz\x00",)], "value string")
    assert {(r.path, tuple(r.stages)) for r in R.unmerged(listing).collect()} == {("a b", (1, 2)), ("z", (3,))}
    maps = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)).alias("x"), F.create_map(F.lit("b"), F.lit(3)).alias("y"))
    assert maps.select(R.overlaid(F.col("x"), F.col("y")).alias("m")).first().m == {"a": 1, "b": 3}


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([("s", 3, "c"), ("s", 1, "a"), ("t", 2, "b")], "session_id string, timestamp int, event_type string")
    last = spark.createDataFrame([("s", 7)], "session_id string, seq long")
    got = S.numbered(events, last)
    assert {(r.session_id, r.timestamp, r.seq) for r in got.collect()} == {("s", 1, 8), ("s", 3, 9), ("t", 2, 1)}
    S.append(got, str(tmp_path / "log"), by=["session_id"])
    S.append(got, str(tmp_path / "log"), by=["session_id"])
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    assert json.loads(S.advisory(events, F.lit("why")).first().payload) == {"advisory": True, "reason": "why"}
    kept = S.stored(spark.createDataFrame([("k", "x"), ("k", "x"), ("k", None), ("l", "x")], "kind string, c string"), F.col("kind"), F.col("c")).collect()
    assert sorted((r.kind, r.content, len(r.key)) for r in kept) == [("k", "x", 16), ("l", "x", 16)]


def test_vector_cache(spark, tmp_path):
    path = str(tmp_path / "vec")
    first = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("a", [3.0, 4.0])], "content_key string, embedding array<double>")
    assert S.vectors(spark, path) is None
    assert S.add_vectors(first, path) == 2
    assert S.add_vectors(first, path) == 0
    assert {r.content_key: r.embedding for r in S.vectors(spark, path).collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0]}
    asked = spark.createDataFrame([("a",), ("z",)], "content_key string")
    assert [r.content_key for r in S.missing_keys(asked, S.vectors(spark, path)).collect()] == ["z"]
    assert S.add_vectors(spark.createDataFrame([("q", [1.0])], "content_key string, embedding array<double>"), path) == 1
    assert [r.content_key for r in S.vectors(spark, path).collect()] == ["q"]


def test_instruction_pairs(spark, tmp_path):
    lines = ['{"example": {"resolved": "r1"}, "outcome": "accepted", "unit_id": "u1"}', '{"example": {"resolved": "r2"}, "outcome": "accepted", "unit_id": "u2"}', '{"example": {"resolved": "r3"}, "outcome": "rejected", "unit_id": "u1"}']
    o = R.outcomes(spark, write(tmp_path / "o.jsonl", "\n".join(lines)))
    a = spark.createDataFrame([("u1", "p1", "resp"), ("u2", "p2", None)], "unit_id string, prompt string, response string")
    assert sorted(map(tuple, S.instruction_pairs(o, a).collect())) == [("p1", "resp"), ("p2", '{"resolved_text":"r2"}')]


def test_scratch_is_kept_apart_and_discarded(spark, tmp_path, monkeypatch):
    import os

    from siltstone.sources import scratch as T

    monkeypatch.setattr(T, "shared_dir", lambda _: str(tmp_path))
    assert T.written(spark.range(3), "x").count() == 3
    (tmp_path / "siltstone" / "another-application").mkdir()
    T.discard(spark)
    assert os.listdir(tmp_path / "siltstone") == ["another-application"]


def test_a_local_session_without_a_shared_folder_gets_one():
    from types import SimpleNamespace

    import pytest

    from siltstone.sources import scratch as T

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="test-app"))
    assert T.shared_dir(session("local[2]")) == T.shared_dir(session("local[2]"))
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            T.shared_dir(session(master))


def test_plans_are_commits_in_order(spark, tmp_path):
    plan = {"source_commits": [{"oid": "a", "index": 0, "changed_paths": ["x", "y"]}, {"oid": "b", "subject": "s"}], "target_base_oid": "t"}
    write(tmp_path / "p" / "1.json", json.dumps(plan, indent=1))
    write(tmp_path / "p" / "2.json", json.dumps({"created_at": "now"}))
    got = H.commits(spark, str(tmp_path / "p")).orderBy("place").collect()
    assert [(r.place, r.oid, r.target_base_oid, r.created_at, r.changed_paths) for r in got] == [(0, "a", "t", "", ["x", "y"]), (1, "b", "t", "", None)]


def test_recorded_histories(spark, tmp_path):
    """Deletions, several changes at one place, a path that comes back, nulls, a filter on folders, a stream, nothing."""
    root = str(tmp_path / "h")
    rows = [("a", 1, "f", "one"), ("a", 3, "f", None), ("a", 5, "f", "two"), ("a", 5, "f", None), ("a", 2, "g", ""), ("a", 4, "g", ""), ("b", 1, "f", "x"), ("b", 900, "f", "y"), (None, 1, "f", "n"), ("a", 1, "f", "one")]
    H.record(spark.createDataFrame(rows, H.CHANGE), root)
    changes = H.recorded(spark, root)
    assert sorted(map(str, ((r.history, r.place, r.path, r.blob) for r in changes.collect()))) == sorted(map(str, rows))
    assert "PartitionFilters: [isnotnull(part" in changes.filter("part = 3")._jdf.queryExecution().toString()
    asked = spark.createDataFrame([("a", p, f) for p in range(7) for f in "fg"] + [("b", 950, "f"), (None, 2, "f"), ("z", 1, "f"), ("a", 1, "f")], "history string, place long, path string")
    got = sorted(((str(r.history), r.place, r.path, r.blob) for r in H.blobs_at(changes, asked).collect()), key=str)
    state = {("f", p): "one" if p in (1, 2) else "two" if p > 4 else None for p in range(7)} | {("g", p): "" if p > 1 else None for p in range(7)}
    assert got == sorted([("a", p, f, state[f, p]) for f, p in state] + [("b", 950, "f", "y"), ("None", 2, "f", "n"), ("z", 1, "f", None), ("a", 1, "f", "one")], key=str)
    pairs = spark.createDataFrame([("a", 1, 3), ("a", 1, 3), ("a", 0, 6), ("a", 3, 5), ("a", 3, 3), ("a", 1, 5), ("a", 2, 4), ("b", 1, 900), (None, 0, 2)], "history string, old long, new long")
    for width in (1, 100):
        got = {tuple(r) for r in H.changed_paths(changes, pairs, width).collect()}
        assert got == {("a", 1, 3, "f", "deleted"), ("a", 1, 3, "g", "added"), ("a", 0, 6, "f", "added"), ("a", 0, 6, "g", "added"), ("a", 3, 5, "f", "added"), ("a", 1, 5, "f", "modified"), ("a", 1, 5, "g", "added"), ("a", 2, 4, "f", "deleted"), ("b", 1, 900, "f", "modified")}
    assert H.changed_paths(changes.limit(0), pairs).count() == 0 and H.blobs_at(changes, asked.limit(0)).count() == 0
    H.recorded(spark, root, stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_sections_of_a_prompt(spark):
    heads = {"a": "# a", "b": "# b", "c": "# c"}
    texts = ["x\r\n# a\r\none\r\n\r\n two \r\n\r\n# b\n# c\nthree\n```\nrest", "# a\n# a\n# b\n \n", "# b\nx\n# a\ny", "# a\nonly", "", None, "# a # b"]
    got = [r.s and tuple(r.s) for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(R.sections(F.col("x"), heads, ("c",), "^```").alias("s")).collect()]
    assert got == [("one\n\n two ", "", "three"), ("# a", "", ""), ("y", "x\n# a\ny", ""), None, None, None, None]
