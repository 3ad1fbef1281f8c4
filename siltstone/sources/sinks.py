"""Writers: logs with increasing numbers, content-addressed stores, vector caches, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.stats import running
from siltstone.functions.text import content_key
from siltstone.functions.vectors import unit


def append(df: DataFrame, path: str, kind: str = "json", by: list[str] | None = None) -> None:
    """Appends rows; ``by`` partitions the files."""
    out = df.write.mode("append").format(kind)
    (out.partitionBy(*by) if by else out).save(path)


def numbered(events: DataFrame, last: DataFrame | None = None, keys: tuple[str, ...] = ("session_id",), order: str = "timestamp") -> DataFrame:
    """Events with ``seq`` going on, per session, from that of ``last`` (session and ``seq``). Where ``order`` ties, the rows' JSON decides, so a second run gives the same numbers. Sessions are numbered by ranges, so one with most events is many tasks."""
    once = events.groupBy(*events.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_json", F.to_json(F.struct(*events.columns)))
    ends = running(once, list(keys), [order, "_json"], {"_upto": F.col("_n")})  # equal events take numbers in a row
    out = ends.select(*events.columns, F.explode(F.sequence(F.col("_upto") - F.col("_n") + 1, "_upto")).alias("seq"))
    if last is None:
        return out
    top = last.groupBy(*keys).agg(F.max("seq").alias("_top"))
    return out.join(top, list(keys), "left").withColumn("seq", F.col("seq") + F.coalesce("_top", F.lit(0))).drop("_top")


def advisory(events: DataFrame, reason: Column) -> DataFrame:
    """Events marked as advice in their payload."""
    return events.withColumn("payload", F.to_json(F.struct(F.lit(True).alias("advisory"), reason.alias("reason"))))


def stored(df: DataFrame, kind: Column, content: Column) -> DataFrame:
    """``kind, key, content``: each content once, under its address; of equal ones one is kept."""
    rows = df.select(kind.alias("kind"), content.alias("content")).filter("content IS NOT NULL").withColumn("key", content_key(F.col("content")))
    return rows.groupBy("kind", "key").agg(F.min("content").alias("content"))


def add_vectors(new: DataFrame, path: str, key_col: str = "content_key", vec_col: str = "embedding") -> int:
    """Appends unit vectors whose keys a cache at ``path`` doesn't have, first of equal keys; a cache of another dimension is replaced. Returns how many were added."""
    spark = new.sparkSession
    rows = new.select(F.col(key_col).alias("content_key"), unit(F.col(vec_col)).alias("embedding")).filter("content_key IS NOT NULL AND embedding IS NOT NULL").dropDuplicates(["content_key"])
    old = vectors(spark, path)
    mode = "append"
    if old is not None:
        one, other = old.select(F.size("embedding").alias("n")).first(), rows.select(F.size("embedding").alias("n")).first()
        if one and other and one["n"] != other["n"]:
            mode = "overwrite"
        else:
            rows = rows.join(old, "content_key", "left_anti")
    count = rows.count()
    rows.write.mode(mode).parquet(path)
    return count


def vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """A cache of vectors, or None where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("content_key string, embedding array<double>").parquet(path)


def missing_keys(asked: DataFrame, cache: DataFrame, key_col: str = "content_key") -> DataFrame:
    """Rows whose key the cache doesn't have: what is left to embed."""
    return asked.join(cache.select(key_col).distinct(), key_col, "left_anti")


def instruction_pairs(outcomes: DataFrame, artefacts: DataFrame) -> DataFrame:
    """``instruction, output`` of accepted outcomes with a prompt: the recorded response, or the resolved text as JSON."""
    ok = outcomes.filter((F.col("outcome") == "accepted") & F.col("unit_id").isNotNull() & (F.col("example.resolved") != ""))
    rows = ok.join(artefacts.select("unit_id", "prompt", "response"), "unit_id", "left").filter("prompt IS NOT NULL")
    return rows.select(F.col("prompt").alias("instruction"), F.coalesce("response", F.to_json(F.struct(F.col("example.resolved").alias("resolved_text")))).alias("output"))
