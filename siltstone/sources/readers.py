"""Readers: outcome logs (lenient), journals (strict), archives of file roles, tool output, conflict markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXAMPLE = "summary string, base string, current string, replayed string, resolved string, source string"
OUTCOME = (
    f"example struct<{', '.join(x.replace(' ', ':') for x in EXAMPLE.split(', '))}>, outcome string, language string, path string, session_id string, unit_id string, "
    "validator_features map<string,string>, risk_score double, retry_count int, history_features map<string,string>, provenance string, region_kind string, "
    "conflict_shape string, parse_success boolean, layout_used string, samples_used int, failure_mode string"
)
EVENT = "seq long, timestamp timestamp, session_id string, event_type string, git_head_before string, git_head_after string, step_index int, path string, unit_id string, payload string"


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Labelled outcomes from JSON lines; broken lines and lines without an example are left out, missing fields get their defaults.

    The whole schema is read before broken lines are dropped, as pruning columns would change what counts as broken.
    """
    rows = spark.read.schema(OUTCOME + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = rows.filter("_broken IS NULL AND example IS NOT NULL").drop("_broken")
    return rows.withColumns({"outcome": F.coalesce("outcome", F.lit("")), "provenance": F.coalesce("provenance", F.lit("")), "risk_score": F.coalesce("risk_score", F.lit(0.0)), "retry_count": F.coalesce("retry_count", F.lit(0))})


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON lines; a broken line is an error. The payload stays JSON text."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)


def sessions(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """``session_id, n_files, bytes`` of the folders under ``root`` that hold files like ``pattern``; only file listings are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("session_id"), "length").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


def cases(spark: SparkSession, path: str, schema: str, language: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """One JSON document per file, filtered by language and id where given."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    rows = rows if language is None else rows.filter(F.col("language") == language)
    return rows if ids is None else rows.filter(F.col("id").isin(ids))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """An archive of ``case/role.ending`` files as one row per case: ``case, base, current, replayed, merged``, from roles O, A, B and M."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root).select("value", F.col("_metadata.file_path").alias("file"))
    parts = files.select("value", F.element_at(F.split("file", "/"), -2).alias("case"), F.upper(F.regexp_extract("file", r"/([^/.]+)(\.[^/]*)?$", 1)).alias("role"))
    pick = lambda r: F.min(F.when(F.col("role") == r, F.col("value")))
    return parts.groupBy("case").agg(pick("O").alias("base"), pick("A").alias("current"), pick("B").alias("replayed"), pick("M").alias("merged"))


def unmerged(listing: DataFrame, col: str = "value") -> DataFrame:
    """Stages per path from NUL-separated ``mode oid stage<TAB>path`` listings: ``path, stages``."""
    entry = listing.select(F.explode(F.split(F.col(col), "\u0000")).alias("e")).filter("e != ''")
    got = entry.select(F.regexp_extract("e", r"^\S+ \S+ (\d)\t", 1).try_cast("int").alias("stage"), F.regexp_extract("e", r"(?s)\t(.*)$", 1).alias("path"))
    return got.groupBy("path").agg(F.sort_array(F.collect_set("stage")).alias("stages"))


def marker_blocks(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Conflict blocks of texts: ``id, block, first_line, last_line, current, base, replayed`` (line numbers from 0).

    A line's section follows from the markers before it, by a window over the text's lines; blocks without an end are left
    out. A text's lines are one group, as a text is one row.
    """
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "text"))
    mark = lambda p: F.col("text").rlike(p)
    section = F.when(mark("^<<<<<<<"), "start").when(mark(r"^\|\|\|\|\|\|\|"), "base_mark").when(mark("^=======$"), "middle").when(mark("^>>>>>>>"), "end")
    w = Window.partitionBy("id").orderBy("line")
    rows = lines.withColumn("mark", section).withColumn("block", F.count_if(F.col("mark") == "start").over(w)).filter("block > 0")
    inside = Window.partitionBy("id", "block").orderBy("line")
    rows = rows.withColumn("in", F.last("mark", ignorenulls=True).over(inside))
    text = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("in") == s) & F.col("mark").isNull(), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    out = rows.groupBy("id", "block").agg(F.min("line").alias("first_line"), F.min(F.when(F.col("mark") == "end", F.col("line"))).alias("last_line"), text("start").alias("current"), text("base_mark").alias("base"), text("middle").alias("replayed"))
    return out.filter("last_line IS NOT NULL")


def diagnostics(lines: DataFrame, col: str = "value") -> DataFrame:
    """Compiler messages from JSON lines: ``level, code, message, file, line``; other lines are left out."""
    schema = "reason string, message struct<level:string,message:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:int,is_primary:boolean>>>"
    m = lines.select(F.from_json(F.col(col), schema).alias("j")).filter("j.reason = 'compiler-message'")
    span = F.get(F.filter("j.message.spans", lambda s: F.coalesce(s["is_primary"], F.lit(False))), 0)
    return m.select(F.col("j.message.level").alias("level"), F.coalesce("j.message.code.code", F.lit("")).alias("code"), F.col("j.message.message").alias("message"), span["file_name"].alias("file"), span["line_start"].alias("line"))


def text_diagnostics(lines: DataFrame, col: str = "value") -> DataFrame:
    """Messages like ``file:line:column: error: text``: ``file, line, level, message``."""
    p = r"^([^:\s]+):(\d+):(?:\d+:)?\s*(error|warning)(?:\[\w+\])?:\s*(.*)$"
    part = lambda i: F.regexp_extract(F.col(col), p, i)
    return lines.filter(F.col(col).rlike(p)).select(part(1).alias("file"), part(2).try_cast("int").alias("line"), part(3).alias("level"), part(4).alias("message"))


def passing_tests(output: DataFrame, col: str = "value") -> DataFrame:
    """Distinct names of tests that passed, from the lines of several runners' output."""
    line = output.select(F.explode(F.split(F.col(col), "\r?\n")).alias("l"))
    a, b = F.regexp_extract("l", r"^(\S+::\S+)\s+PASSED", 1), F.regexp_extract("l", r"^test (\S+) \.\.\. ok$", 1)
    c = F.regexp_extract("l", r"^--- PASS: (\S+)", 1)
    name = F.when(a != "", a).when(b != "", b).otherwise(c)
    return line.select(name.alias("test")).filter("test != ''").distinct()


def test_verdict(timed_out: Column, code: Column, stdout: Column, stderr: Column) -> Column:
    """What a test run says, by the first sign that holds."""
    both = F.concat_ws("\n", stdout, stderr)
    return (
        F.when(timed_out, "timeout")
        .when(both.rlike("(?i)command not found|no such file or directory|is not recognized"), "tool_missing")
        .when(both.rlike("(?i)collected 0 items|no tests ran|running 0 tests"), "no_tests")
        .when(both.rlike("(?im)^(error(\\[|:)|syntaxerror)|compilation failed|could not compile"), "build_failed")
        .when(code == 0, "passed")
        .when(both.rlike("(?i)\\bfailed\\b|--- FAIL"), "failed")
        .otherwise("unknown")
    )


def overlaid(base: Column, over: Column) -> Column:
    """A map with another's entries laid over it."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def sections(text: Column, headers: dict[str, str], optional: tuple[str, ...] = (), stops: str | None = None) -> Column:
    """The parts of a stored prompt as a struct of ``headers``' names: a part runs from behind the first line that is its header to the next line that is the header of a later name, without the blank lines at its end.

    Null if a header is missing that isn't ``optional``, whose part then is empty; the last part ends before a line that
    matches ``stops``, too. A null text gives null. Lines end by newline, carriage return or both.
    """
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    names = list(headers)

    def part(i: int) -> Column:
        start, later = F.array_position(lines, headers[names[i]]), [F.lit(headers[n]) for n in names[i + 1 :]]
        ends = lambda x: (x.isin(later) if later else F.lit(False)) | (x.rlike(stops) if stops and i == len(names) - 1 else F.lit(False))
        rest = F.slice(lines, start + 1, F.size(lines))
        marks = F.filter(F.transform(rest, lambda x, j: F.when(ends(x), j)), lambda j: j.isNotNull())
        body = F.array_join(F.slice(rest, 1, F.coalesce(F.get(marks, 0), F.size(rest))), "\n")
        return F.when(start > 0, F.regexp_replace(body, r"(?:^|\n)\s*\z", "")).otherwise("").alias(names[i])

    there = F.lit(True)
    for n in names:
        if n not in optional:
            there = there & (F.array_position(lines, headers[n]) > 0)
    return F.when(there, F.struct(*[part(i) for i in range(len(names))]))
