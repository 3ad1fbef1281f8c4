"""Queries on logs, journals, stores and tool output that are written to a folder and read back."""

from pyspark.sql import functions as F

from siltstone.plans.registry import query
from siltstone.sources import readers as R
from siltstone.sources import sinks as S
from siltstone.sources.scratch import scratch


def _lines(t, frame, name):
    """Rows of one text column as lines of files, read back as lines."""
    path = scratch(t.spark, name)
    frame.write.text(path)
    return t.spark.read.text(path)


def _outcomes(t):
    """A log of outcomes of documents: every seventh line breaks off, every eleventh has no example, some have no number of retries."""
    d = F.col("doc_id")
    example = F.struct(d.cast("string").alias("summary"), F.col("lang").alias("base"), F.when(d % 4 > 0, F.col("source")).otherwise("").alias("resolved"))
    row = F.struct(F.when(d % 11 > 0, example).alias("example"), F.when(d % 3 == 0, "accepted").when(d % 3 == 1, "rejected").alias("outcome"), F.when(d % 2 == 0, d % 5).alias("retry_count"), d.cast("string").alias("unit_id"))
    line = F.to_json(row)
    path = scratch(t.spark, "outcomes")
    t("documents").select(F.when(d % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return R.outcomes(t.spark, path)


@query("""SELECT doc_id::VARCHAR AS summary, CASE doc_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE '' END AS outcome, (CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 ELSE 0 END)::INT AS retry_count, 0.0::DOUBLE AS risk_score, lang FROM documents WHERE doc_id % 7 > 0 AND doc_id % 11 > 0""")
def outcome_log(t):
    """Outcomes from a log with broken lines, lines without an example and missing fields."""
    return _outcomes(t).select("example.summary", "outcome", "retry_count", "risk_score", F.col("example.base").alias("lang"))


@query("""SELECT 'Q' || doc_id AS instruction, CASE WHEN doc_id % 5 = 0 THEN source ELSE '{"resolved_text":"' || source || '"}' END AS output FROM documents WHERE doc_id % 7 > 0 AND doc_id % 11 > 0 AND doc_id % 3 = 0 AND doc_id % 4 > 0 AND source <> ''""")
def instruction_file(t):
    """Instructions and answers from accepted outcomes of a log, appended to a file of JSON lines and read back."""
    d = F.col("doc_id")
    artefacts = t("documents").select(d.cast("string").alias("unit_id"), F.concat(F.lit("Q"), d).alias("prompt"), F.when(d % 5 == 0, F.col("source")).alias("response"))
    path = scratch(t.spark, "instructions")
    S.append(S.instruction_pairs(_outcomes(t), artefacts), path)
    return t.spark.read.schema("instruction string, output string").json(path)


@query("""SELECT user_id::VARCHAR AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, ts, event_type, event_id::VARCHAR) AS seq, event_type = 'error' AS advice FROM events""")
def journal_numbers(t):
    """Events appended to a journal in two goes, the second counting on from the first; errors are written as advice. Read back strictly."""
    e = t("events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("timestamp"), "event_type", F.col("event_id").cast("string").alias("unit_id"), (F.col("event_id") % 2).alias("half"))
    path = scratch(t.spark, "journal")
    for half in (0, 1):
        some = e.filter(F.col("half") == half).drop("half")
        marked = S.advisory(some.filter("event_type = 'error'"), F.lit("an error")).unionByName(some.filter("NOT event_type <=> 'error'"), allowMissingColumns=True)
        last = R.journal(t.spark, path).select("session_id", "seq") if half else None
        S.append(S.numbered(marked, last), path)
    return R.journal(t.spark, path).select("session_id", F.col("unit_id").cast("long").alias("event_id"), "seq", F.coalesce(F.get_json_object("payload", "$.advisory") == "true", F.lit(False)).alias("advice"))


@query("""SELECT 'event_type=' || event_type AS session_id, sum(length(event_id::VARCHAR) + 14)::BIGINT AS bytes FROM events GROUP BY 1""")
def session_folders(t):
    """Folders of a journal, a folder for each type of event, from their listing alone."""
    path = scratch(t.spark, "folders")
    S.append(t("events").select("event_id", "event_type"), path, by=["event_type"])
    return R.sessions(t.spark, path, "*.json").select("session_id", "bytes")


@query("""SELECT l_orderkey::VARCHAR || ' ' || (l_partkey % 3) AS path, array_to_string(list_sort(list_distinct(list(1 + l_linenumber % 3))), ',') AS stages FROM lineitem GROUP BY 1""")
def unmerged_paths(t):
    """Stages of each path, from listings whose entries are parted by NUL; paths have a blank."""
    stage, path = 1 + F.col("l_linenumber") % 3, F.concat("l_orderkey", F.lit(" "), F.col("l_partkey") % 3)
    entry = F.concat(F.lit("100644 "), F.sha1(path), F.lit(" "), stage, F.lit("\t"), path, F.lit("\0"))
    return R.unmerged(_lines(t, t("lineitem").select(entry.alias("value")), "unmerged")).select("path", F.array_join("stages", ",").alias("stages"))


@query(r"""WITH x AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS b, role FROM conversations)
SELECT conv_id, turn, 1 AS block, 1::BIGINT AS first_line, (len(b) + 6)::BIGINT AS last_line, md5(array_to_string(b, chr(10))) AS current, role AS base, 'end' AS replayed FROM x WHERE role IS NOT NULL""")
def conflict_blocks(t):
    """Blocks between conflict markers: a turn's text against one line, with the role as base; a second block has no end."""
    text = F.coalesce("text", F.lit(""))
    marked = F.concat(F.lit("ahead\n<<<<<<< ours\n"), text, F.lit("\n||||||| base\n"), "role", F.lit("\n=======\nend\n>>>>>>> theirs\n<<<<<<< ours\n"), text)
    rows = t("conversations").filter("role IS NOT NULL").select(F.struct("conv_id", "turn").alias("key"), marked.alias("text"))
    path = scratch(t.spark, "marked")
    S.append(rows, path, "parquet")
    got = R.marker_blocks(t.spark.read.schema(rows.schema).parquet(path), "key", "text")
    return got.select("id.conv_id", "id.turn", F.col("block").cast("int").alias("block"), F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), F.md5("current").alias("current"), "base", "replayed")


@query("""SELECT CASE WHEN p_size % 2 = 0 THEN 'error' ELSE 'warning' END AS level, CASE WHEN p_partkey % 3 = 1 AND p_size % 5 > 0 THEN 'E' || p_size ELSE '' END AS code, p_name AS message, 'src/' || lower(p_type) || '.rs' AS file, p_partkey::INT AS line FROM part WHERE p_partkey % 3 > 0""")
def tool_messages(t):
    """Messages from a tool's output: as JSON, as text, and lines that are neither."""
    k, level = F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, "error").otherwise("warning")
    file = F.concat(F.lit("src/"), F.lower("p_type"), F.lit(".rs"))
    span = lambda at, own: F.struct(file.alias("file_name"), at.alias("line_start"), F.lit(own).alias("is_primary"))
    code = F.when(F.col("p_size") % 5 > 0, F.struct(F.concat(F.lit("E"), "p_size").alias("code")))
    json = F.to_json(F.struct(F.lit("compiler-message").alias("reason"), F.struct(level.alias("level"), F.col("p_name").alias("message"), code.alias("code"), F.array(span(k + 1, False), span(k, True)).alias("spans")).alias("message")))
    text = F.concat(file, F.lit(":"), k, F.lit(":7: "), level, F.lit(": "), "p_name")
    lines = _lines(t, t("part").select(F.when(k % 3 == 1, json).when(k % 3 == 2, text).otherwise(F.concat(F.lit("   Compiling "), "p_name")).alias("value")), "messages")
    return R.diagnostics(lines).unionByName(R.text_diagnostics(lines).withColumn("code", F.lit("")))


@query("""SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'tests/' || lower(p_type) || '.py::t' || p_size WHEN 1 THEN lower(p_type) || '::t' || p_size ELSE 'Test' || p_size END AS test FROM part WHERE p_partkey % 4 < 3 AND p_size % 3 > 0""")
def tests_that_pass(t):
    """Names of passing tests from the output of three runners, with failing ones and other lines between."""
    k, good, kind, n = F.col("p_partkey") % 4, F.col("p_size") % 3 > 0, F.lower("p_type"), F.col("p_size")
    say = lambda yes, no: F.when(good, yes).otherwise(no)
    line = F.when(k == 0, F.concat(F.lit("tests/"), kind, F.lit(".py::t"), n, say(" PASSED", " FAILED"))).when(k == 1, F.concat(F.lit("test "), kind, F.lit("::t"), n, say(" ... ok", " ... FAILED")))
    return R.passing_tests(_lines(t, t("part").select(line.when(k == 2, F.concat(say("--- PASS: Test", "--- FAIL: Test"), n, F.lit(" (0.0s)"))).otherwise(F.concat(F.lit("ok "), n)).alias("value")), "tests"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'tool_missing' WHEN 2 THEN 'no_tests' WHEN 3 THEN 'build_failed' WHEN 4 THEN 'passed' WHEN 5 THEN 'failed' ELSE 'unknown' END AS verdict FROM part""")
def test_run_verdicts(t):
    """What runs of tests say, from their code and output in a log."""
    k = F.col("p_partkey") % 7
    out = F.when(k == 2, "collected 0 items").when(k == 4, F.concat("p_size", F.lit(" passed"))).when(k == 5, F.concat("p_size", F.lit(" failed"))).otherwise(F.col("p_name"))
    err = F.when(k == 1, "sh: command not found").when(k == 3, F.concat(F.lit("note\nerror["), "p_size", F.lit("]"))).otherwise("")
    path = scratch(t.spark, "runs")
    S.append(t("part").select("p_partkey", (k == 0).alias("late"), F.when(k == 4, 0).otherwise(1).alias("code"), out.alias("out"), err.alias("err")), path)
    runs = t.spark.read.schema("p_partkey long, late boolean, code int, out string, err string").json(path)
    return runs.select("p_partkey", R.test_verdict(F.col("late"), F.col("code"), F.col("out"), F.col("err")).alias("verdict"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id::VARCHAR AS content_key, vec_id % 3 < 2 AS cached, CASE WHEN vec_id % 3 < 2 THEN round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) END AS first FROM e""")
def vector_cache(t):
    """Vectors added to a cache in two goes that overlap, and the keys that it still lacks."""
    e = t("embeddings").filter("embedding IS NOT NULL").select("vec_id", F.col("vec_id").cast("string").alias("content_key"), "embedding")
    path = scratch(t.spark, "vectors")
    S.add_vectors(e.filter("vec_id % 3 = 0"), path)
    S.add_vectors(e.filter("vec_id % 3 < 2"), path)
    cache = S.vectors(t.spark, path)
    left = S.missing_keys(e.select("content_key"), cache)
    return cache.select("content_key", F.lit(True).alias("cached"), F.round(F.col("embedding")[0], 5).alias("first")).unionByName(left.select("content_key", F.lit(False).alias("cached"), F.lit(None).cast("double").alias("first")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE 'given' END AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS extra FROM orders""")
def settings_overlaid(t):
    """Given settings with a row's own laid over them."""
    k = F.col("o_orderkey")
    none = F.create_map().cast("map<string,string>")
    given = F.create_map(F.lit("status"), F.lit("given"), F.lit("priority"), F.col("o_orderpriority"))
    own = F.map_concat(F.when(k % 2 == 0, F.create_map(F.lit("status"), F.lit("own"))).otherwise(none), F.when(k % 3 == 0, F.create_map(F.lit("extra"), F.col("o_orderstatus"))).otherwise(none))
    return t("orders").select("o_orderkey", R.overlaid(given, own).alias("m")).select("o_orderkey", "m.status", "m.priority", "m.extra")
