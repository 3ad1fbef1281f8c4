"""Exact deduplication against a persistent digest index.

The index is a Parquet table with one row per distinct text (SHA-256 of the normalised text), bucketed and sorted by
digest, so that a new batch meets it in a sort-merge join in which only the batch is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import ascii_lower, perhaps, scratch, sized, table, written

COLUMNS = ("digest", "keep_id", "copies", "repeats", "batch")


class DigestIndex:
    """``digest binary, keep_id, copies long, repeats long, batch string``, bucketed and sorted by digest.

    ``keep_id`` is the document that stands for the text, ``copies`` the rows that had the text when it was first
    appended, ``repeats`` how many of those rows carried ``keep_id`` itself, ``batch`` the batch that brought it. What
    holds for the whole index, the number of buckets and the type of the ids, is written beside it when it is created
    (buckets: the session's shuffle partitions unless given) and read when it is opened; a number or a type that
    differs is refused. After ``merge_after`` appends the files of each bucket are merged into one sorted file.

    Used with ``with``, or closed by ``close``, it leaves no table in the session's catalog; the files stay.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: T.DataType | None = None, merge_after: int = 8):
        self.spark, self.path, self.merge_after = spark, path or scratch(spark, "digests"), merge_after
        kind = id_type.simpleString() if id_type is not None else None
        try:
            state = self._states().orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            state = None  # nothing there: a new index
        if state is None:
            state = T.Row(version=0, buckets=buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), id_type=kind or "bigint", appends=0, folder="data-0")
            self._put(state)
        if buckets not in (None, state["buckets"]):
            raise ValueError(f"the index at {self.path} has {state['buckets']} buckets, not {buckets}")
        if kind not in (None, state["id_type"]):
            raise ValueError(f"the index at {self.path} has ids of type {state['id_type']}, not {kind}")
        self.state, self.name = state, None
        self._open()

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _states(self) -> DataFrame:
        return self.spark.read.schema("version long, buckets int, id_type string, appends int, folder string").parquet(f"{self.path}/states")

    def _put(self, state: T.Row) -> None:
        self.spark.createDataFrame([tuple(state)], "version long, buckets int, id_type string, appends int, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/states")

    def _open(self) -> None:
        if self.name:
            self.close()
        self.name = f"siltstone_digests_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {self.state['id_type']}, copies BIGINT, repeats BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{self.state['folder']}'"
        )

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Adds rows whose digests aren't in the index, a sorted file for each bucket; merges the files when there are many."""
        if self.state["appends"] >= self.merge_after:
            self.merge()
        self._write(rows.select(*COLUMNS), self.name, self.state["folder"])
        self._step(appends=self.state["appends"] + 1)

    def merge(self) -> None:
        """Rewrites the index with one file for each bucket. The buckets stay as they are, so nothing is shuffled. The new files are used once all are written; the old ones are left for readers that have them open."""
        folder, name = f"data-{uuid.uuid4().hex}", f"siltstone_digests_{uuid.uuid4().hex}"
        self._write(self.table(), name, folder)
        self.spark.sql(f"DROP TABLE {name}")
        self._step(appends=1, folder=folder)
        self._open()

    def _write(self, rows: DataFrame, name: str, folder: str) -> None:
        dealt = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        dealt.write.format("parquet").mode("append").option("path", f"{self.path}/{folder}").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    def _step(self, **changes: object) -> None:
        self.state = T.Row(**(self.state.asDict() | changes | {"version": self.state["version"] + 1}))
        self._put(self.state)


def text_digest(c: Column) -> Column:
    """SHA-256 of a text with A-Z lower-cased; a null text counts as empty."""
    return F.unhex(F.sha2(ascii_lower(c), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest`` of every row; the id keeps its type."""
    return docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Decides for every row of ``docs`` whether it stays; appends the new texts to ``index``.

    Returns one row per input row: ``doc_id, digest, keep_id, group_size, kept, repeats, text_sha256``. Of equal texts in
    the batch, the row with the largest id stays, unless the index has the text: then none of them stays and ``keep_id``
    names the indexed document. ``group_size`` counts the batch's rows with the text. Texts are equal when identical
    after lower-casing A-Z; null is empty. Rows that repeat an id and a text are all marked kept, with ``repeats`` over
    1; a null id stays only if all ids of its text are null. An empty table gives no rows. Other columns are ignored.
    Ids are of any type that has an order; one that isn't the index's is refused.

    ``batch`` names the rows: when the same rows are given again under the same name, as after a driver was lost, they
    meet the index as it was before them, so the decisions are the same and nothing is appended twice.

    Narrow rows (id and digest) are written once and grouped with map-side combination; decisions are joined back by a
    sort-merge join of two plain scans, whose hot digests adaptive execution can split.
    """
    own = index is None
    rows = written(digests(docs, id_col, text_col), "rows")
    n = rows.count()
    if own:  # asked and forgotten: as many buckets as these rows need
        most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        index = DigestIndex(docs.sparkSession, buckets=max(1, min(most, -(-n // 100_000))), id_type=docs.schema[id_col].dataType)
    out = _decide(rows, index, batch or uuid.uuid4().hex, n, own)
    if own:
        index.close()
    return out


def _decide(rows: DataFrame, index: DigestIndex, batch: str, n: int, empty: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """``dedup`` of at most ``n`` rows ``doc_id, digest``; ``empty`` says that the index is. ``sizes`` (``digest, copies``) gives the groups' sizes where they aren't those of these rows."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    if kind != index.state["id_type"]:
        raise ValueError(f"the index has ids of type {index.state['id_type']}, the rows of type {kind}")
    per_id = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    texts = per_id.groupBy("digest").agg(F.max(F.struct("doc_id", "n")).alias("last"), F.sum("n").alias("copies"))
    texts = written(sized(texts.select("digest", F.col("last.doc_id").alias("keep_id"), "copies", F.col("last.n").alias("repeats")), n, 100_000), "batch")
    known = index.table().select("digest", F.col("keep_id").alias("known_id"), F.col("batch").alias("by"))
    before = known.filter(F.col("by") != batch).drop("by")
    fresh = texts.hint("merge").join(before, "digest", "left_anti").withColumn("fresh", F.lit(True))
    if empty:
        decided = written(sized(fresh, n, 100_000), "decided")
    else:
        seen = texts.hint("merge").join(before, "digest").select("digest", F.col("known_id").alias("keep_id"), "copies", "repeats", F.lit(False).alias("fresh"))
        decided = written(sized(fresh.unionByName(seen), n, 100_000), "decided")
    new = decided.filter("fresh")
    if not empty:  # what an earlier run of this batch has appended is there already
        new = new.hint("merge").join(known.filter(F.col("by") == batch).select("digest"), "digest", "left_anti")
    index.append(new.withColumn("batch", F.lit(batch)))
    if sizes is not None:
        decided = decided.drop("copies").hint("merge").join(sizes, "digest")
    stays = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return (
        rows.hint("merge")
        .join(decided, "digest")
        .select(
            "doc_id",
            "digest",
            "keep_id",
            F.col("copies").alias("group_size"),
            stays.alias("kept"),
            F.when(stays, F.col("repeats")).otherwise(F.lit(0)).alias("repeats"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def keep_last(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of equal texts that with the largest id, and of rows that repeat both id and text one.

    Decided row by row: a row with a repeated id and another text is another document. A null id counts as smaller than
    any other. An empty table gives no rows.
    """
    decided = dedup(docs, index, id_col, text_col)
    decided = written(sized(decided.filter("NOT kept OR repeats > 1").select("doc_id", "digest", "kept", "repeats"), docs.count(), 100_000), "decided")
    keyed = docs.withColumn("_digest", text_digest(F.col(text_col)))
    return settled(keyed, decided.filter("NOT kept"), decided.filter("repeats > 1"), id_col).select(docs.columns)


def settled(keyed: DataFrame, dropped: DataFrame, repeated: DataFrame, id_col: str) -> DataFrame:
    """``keyed`` without the rows whose id and ``_digest`` are ``doc_id, digest`` of ``dropped``, and with one row, the first in the order of their JSON, of those that share what ``repeated`` has; null ids are equal.

    Most rows can't be meant, as a bitmap of the decisions' digests tells: they stay where they are. The others meet the
    decisions by id and digest, so neither a hot text nor a hot id is one task's, by merging at every size.
    """
    decisions = written(dropped.select("doc_id", "digest", F.lit(False).alias("_again")).unionByName(repeated.select("doc_id", "digest", F.lit(True).alias("_again"))).distinct(), "decisions")
    if not decisions.limit(1).count():
        return keyed
    marked = perhaps(keyed, F.col("_digest"), decisions)
    same = F.col(id_col).eqNullSafe(F.col("_gone")) & (F.col("_digest") == F.col("_of"))
    met = marked.filter("_may").drop("_may").hint("merge").join(decisions.select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_of"), "_again"), same, "left")
    stay = marked.filter("NOT _may").drop("_may").unionByName(met.filter("_again IS NULL").select(keyed.columns))
    if not decisions.filter("_again").limit(1).count():
        return stay
    row = F.struct(*keyed.columns)
    one = met.filter("_again").groupBy("_gone", "_of").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return stay.unionByName(one.select("row.*"))


def dedup_by_batches(docs: DataFrame, index: DigestIndex | None = None, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``dedup``, with the rows dealt to batches by falling id: each is met by an anti-join with the index of those before it, and what is new is appended, so the largest id stays. ``group_size`` counts the rows of all batches. Null ids are in the last batch. ``index`` must be empty, or is a new one."""
    rows = written(digests(docs, id_col, text_col), "rows")
    n = rows.count()
    kind = docs.schema[id_col].dataType
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = index is None
    index = index or DigestIndex(docs.sparkSession, buckets=max(1, min(most, -(-n // 100_000))), id_type=kind)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("at")).first()["at"] if isinstance(kind, T.NumericType) else None
    of = F.lit(batches - 1)
    for i, cut in enumerate(sorted(set(cuts or []))):  # smaller ids are later batches; equal ids are of one
        of = F.when(F.col("doc_id") > cut, F.lit(batches - 2 - i)).otherwise(of)
    dealt = rows.withColumn("_batch", of)
    sizes = written(sized(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), n, 100_000), "sizes")
    out: DataFrame | None = None
    for i in range(batches):
        found = _decide(dealt.filter(F.col("_batch") == i).drop("_batch"), index, f"batch-{i}", n, sizes=sizes)
        out = found if out is None else out.unionByName(found)
    if own:
        index.close()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document with the one that stays of its group."""
    return dedup_by_batches(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
