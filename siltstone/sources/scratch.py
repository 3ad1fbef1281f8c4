"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder of its own; on a cluster it is an error, as the machines wouldn't share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="siltstone-")
        _local[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder; a second call never gives the same."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Deletes all that this application has written to its part of the shared folder; results that weren't saved elsewhere can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int, each: int = 250_000) -> DataFrame:
    """``df`` in as many partitions as ``rows``, the most that one of its steps handles, need at ``each`` a task; never more than it has. Small tables then are few files and few tasks, however many partitions a shuffle has."""
    return df.coalesce(max(1, -(-rows // each)))


def gathered(df: DataFrame, share: int = 16) -> DataFrame:
    """``df`` dealt anew to a ``share``-th of the session's shuffle partitions. For few narrow rows of a step whose work needs all its tasks: the work keeps them, and what is written then is few files."""
    return df.repartition(max(1, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // share)))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
