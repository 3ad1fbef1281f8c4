"""Recorded histories: changes of paths as JSON lines, snapshots and differences between any two of their places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.stats import running

CHANGE = "history string, place long, path string, blob string"
COMMIT = "oid string, subject string, author string, parents array<string>, changed_paths array<string>, patch_id string, index int"
PLAN = f"source_commits array<struct<{', '.join(x.replace(' ', ':', 1) for x in COMMIT.split(', '))}>>, target_base_oid string, target_tip_oid string, source_tip_oid string, created_at string"


def recorded(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """``history, place, path, blob`` from JSON lines in folders ``part=…``; a null blob is a deletion, broken lines are errors.

    ``part`` stays a column: a filter on it reads only its folders. With ``stream``, new files are read as they come.
    """
    reader = spark.readStream if stream else spark.read
    return reader.schema(f"{CHANGE}, part int").option("mode", "FAILFAST").json(root)


def record(changes: DataFrame, root: str, parts: int = 8) -> None:
    """Appends changes to the folder that ``recorded`` reads, each history in one of ``parts`` folders by its hash."""
    rows = changes.select("history", "place", "path", "blob", F.pmod(F.xxhash64("history"), F.lit(parts)).cast("int").alias("part"))
    rows.write.mode("append").option("ignoreNullFields", "false").partitionBy("part").json(root)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """A row per commit of recorded plans, one JSON document per file, in the order in which they are replayed: ``file, target_base_oid, target_tip_oid, source_tip_oid, created_at, place, <commit>``. Missing texts are empty; a plan without commits gives none."""
    plans = spark.read.schema(PLAN).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    tips = [F.coalesce(c, F.lit("")).alias(c) for c in ("target_base_oid", "target_tip_oid", "source_tip_oid", "created_at")]
    return plans.select("file", *tips, F.posexplode("source_commits").alias("place", "commit")).select("file", *[t for t in ("target_base_oid", "target_tip_oid", "source_tip_oid", "created_at")], "place", "commit.*")


def blobs_at(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (with ``history, place, path``) and ``digest, blob`` of the path at that place; null where it isn't there or was deleted.

    Places and digests are dealt by ranges, so a path with most of the changes is many tasks; texts join only what is found.
    Of several changes of a path at one place the one with the greatest digest counts, and a deletion only if it is alone.
    """
    keys = ["history", "path"]
    known = changes.groupBy(*keys, "place").agg(F.max(F.sha1("blob")).alias("digest"))
    none = F.lit(None).cast("struct<place:bigint,digest:string>")
    rows = known.select(*keys, "place", F.struct("place", "digest").alias("at"), F.lit(None).cast(asked.select(F.struct("*").alias("q")).schema["q"].dataType).alias("q"))
    rows = rows.unionByName(asked.select(*keys, "place", none.alias("at"), F.struct("*").alias("q")))
    found = running(rows, keys, ["place"], {"at": F.col("at")}, largest=True).filter("q IS NOT NULL").select("q.*", F.col("at.place").alias("_since"), F.col("at.digest").alias("digest"))
    texts = changes.select(F.col("history").alias("_h"), F.col("path").alias("_p"), F.col("place").alias("_since"), F.sha1("blob").alias("digest"), "blob").dropDuplicates(["_h", "_p", "_since", "digest"])
    out = found.join(texts, (F.col("history").eqNullSafe(F.col("_h"))) & (F.col("path").eqNullSafe(F.col("_p"))) & (found["_since"] == texts["_since"]) & (found["digest"] == texts["digest"]), "left")
    return out.select(*asked.columns, found["digest"], "blob")


def changed_paths(changes: DataFrame, pairs: DataFrame, width: int = 1000) -> DataFrame:
    """``history, old, new, path, change`` for pairs of places (``history, old, new``): paths whose content differs, added, deleted or modified.

    Only paths that change between the places can differ; they are met by the blocks of ``width`` places that a pair
    covers, so pairs never meet all changes of a history. A pair whose ``new`` isn't behind ``old`` gives nothing; pairs that
    repeat count once; a null history has none.
    """
    block = lambda c: F.floor(F.col(c) / width)
    spans = pairs.select("history", "old", "new").distinct().filter("old < new").select("*", F.explode(F.sequence(F.floor((F.col("old") + 1) / width), block("new"))).alias("block"))
    met = spans.join(changes.select("history", block("place").alias("block"), "place", "path").distinct(), ["history", "block"]).filter("place > old AND place <= new")
    met = met.select("history", "old", "new", "path").distinct()
    known = changes.groupBy("history", "path", "place").agg(F.max(F.sha1("blob")).alias("digest"))
    none, pair = F.lit(None), "struct<old:bigint,new:bigint,end:string>"
    ends = met.select("history", "path", F.explode(F.array(*[F.struct(F.col("old").cast("long").alias("old"), F.col("new").cast("long").alias("new"), F.lit(e).alias("end")) for e in ("old", "new")])).alias("q"))
    asked = ends.select("history", "path", F.when(F.col("q.end") == "old", F.col("q.old")).otherwise(F.col("q.new")).alias("place"), none.cast("struct<place:bigint,digest:string>").alias("at"), "q")
    rows = known.select("history", "path", F.col("place").cast("long").alias("place"), F.struct(F.col("place").cast("long").alias("place"), "digest").alias("at"), none.cast(pair).alias("q")).unionByName(asked)
    found = running(rows, ["history", "path"], ["place"], {"at": F.col("at")}, largest=True).filter("q IS NOT NULL")
    side = lambda e: F.max(F.when(F.col("q.end") == e, F.col("at.digest")))
    both = found.groupBy("history", "q.old", "q.new", "path").agg(side("old").alias("a"), side("new").alias("b")).filter("NOT a <=> b")
    return both.select("history", "old", "new", "path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("modified").alias("change"))
