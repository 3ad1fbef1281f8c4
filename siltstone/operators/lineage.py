"""Dependencies, chains and intervals over ordered histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.stats import running


def dependencies(defines: DataFrame, uses: DataFrame) -> DataFrame:
    """``name, definer, user``: each use of a name (``name, oid, pos``) after its first definition by someone else."""
    first = defines.groupBy("name").agg(F.min(F.struct("pos", "oid")).alias("d"))
    used = uses.select("name", F.col("oid").alias("user"), F.col("pos").alias("at")).distinct()
    return used.join(first, "name").filter((F.col("d.pos") < F.col("at")) & (F.col("d.oid") != F.col("user"))).select("name", F.col("d.oid").alias("definer"), "user")


def broken(edges: DataFrame, final: DataFrame, bodies: DataFrame) -> DataFrame:
    """Edges whose ``name`` is gone from ``final`` (``name``), unless its body lives on (``bodies``: ``name`` of those)."""
    return edges.join(final.select("name").distinct(), "name", "left_anti").join(bodies.select("name").distinct(), "name", "left_anti").distinct()


def chains(seen: DataFrame, keys: list[str], pos: str, escalated: Column) -> DataFrame:
    """Groups seen at two or more positions: ``n_commits, first, last, n_escalated`` and what to do."""
    rows = seen.filter(F.col(pos).isNotNull()).groupBy(*keys).agg(F.count_distinct(pos).alias("n_commits"), F.min(pos).alias("first"), F.max(pos).alias("last"), F.count_if(escalated).alias("n_escalated"))
    advice = F.when(F.col("n_escalated") > 0, "manual").when(F.col("n_commits") >= 4, "holistic").when(F.col("n_commits") >= 3, "squash").otherwise("default")
    return rows.filter("n_commits >= 2").withColumn("advice", advice)


def last_change(steps: DataFrame, final: DataFrame) -> DataFrame:
    """Names whose last step (``name, pos, body``) differs from the final ``body``."""
    last = steps.groupBy("name").agg(F.max(F.struct("pos", "body")).alias("s")).select("name", F.col("s.body").alias("step_body"))
    return last.join(final.select("name", F.col("body").alias("final_body")), "name").filter("step_body != final_body")


def net_intent(touches: DataFrame, file: str, name: str, pos: str, removal: Column) -> DataFrame:
    """Last operation per file and name, a removal winning inside one position: ``n_added, n_removed, n_touches`` per file."""
    last = touches.groupBy(file, name).agg(F.max(F.struct(F.col(pos), removal.cast("int").alias("gone"))).alias("last"), F.count(F.lit(1)).alias("n"))
    return last.groupBy(file).agg(F.count_if(F.col("last.gone") == 0).alias("n_added"), F.count_if(F.col("last.gone") == 1).alias("n_removed"), F.sum("n").alias("n_touches"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of intervals ``a_id, a_lo, a_hi`` and ``b_id, b_lo, b_hi`` of equal keys that share a point.

    Intervals are dealt to bins of ``width`` and joined on key and bin; a pair counts in the first bin that both reach, so
    it is given once.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    x, y = a.withColumn("bin", bins("a_lo", "a_hi")), b.withColumn("bin", bins("b_lo", "b_hi"))
    first = F.floor(F.greatest("a_lo", "b_lo") / width)
    return x.join(y, [*keys, "bin"]).filter((F.col("a_lo") <= F.col("b_hi")) & (F.col("a_hi") >= F.col("b_lo")) & (F.col("bin") == first)).drop("bin")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, forward: bool = False) -> DataFrame:
    """Each left row with the nearest right row of its keys at or before (``forward``: at or after) it: columns ``near, near_value``.

    One pass over the union of both sides, sorted within keys; no pairs are formed.
    """
    x = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[at].dataType).alias("_t"), F.lit(1).alias("_side"))
    y = right.select(*keys, F.col(at), F.col(value).alias("_v"), F.col(at).alias("_t"), F.lit(0).alias("_side"))
    order = [F.desc(at), "_side"] if forward else [F.asc(at), "_side"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_t", "_v")), ignorenulls=True).over(w)
    return x.unionByName(y, allowMissingColumns=True).withColumn("_near", seen).filter("_side = 1").select(*left.columns, F.col("_near._t").alias("near"), F.col("_near._v").alias("near_value"))


def islands(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Maximal runs of consecutive positions: ``start, end, n``."""
    w = Window.partitionBy(*keys).orderBy(pos)
    runs = df.select(*keys, pos).distinct().withColumn("_g", F.col(pos) - F.row_number().over(w))
    return runs.groupBy(*keys, "_g").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n")).drop("_g")


def history_features(touches: DataFrame) -> DataFrame:
    """What a history holds around each touch: ``touches``' columns ``history, place, path, region`` once each, and ``commit_index`` (from 0) ``, commit_count, future_file_touches, future_region_touches, recent_file_touches``: places of the history, and those behind or ahead that touch the path, or its region.

    Places are counted by ranges, so a history or path with most touches is dealt to many tasks. Nulls are values of their
    own, a null place is the first.
    """
    rows = touches.select(F.struct("history").alias("history"), F.struct("place").alias("place"), F.struct("path").alias("path"), F.struct("region").alias("region")).distinct()

    def counted(keys: list[str], upto: str) -> DataFrame:
        return running(rows.select(*keys, "place").distinct(), keys, ["place"], {upto: F.lit(1)})

    out = rows.join(counted(["history"], "c"), ["history", "place"]).join(counted(["history", "path"], "f"), ["history", "path", "place"]).join(counted(["history", "path", "region"], "r"), ["history", "path", "region", "place"])
    left = lambda x: F.col(f"{x}_all") - F.col(x)
    return out.select("history.history", "place.place", "path.path", "region.region", (F.col("c") - 1).alias("commit_index"), F.col("c_all").alias("commit_count"), left("f").alias("future_file_touches"), left("r").alias("future_region_touches"), (F.col("f") - 1).alias("recent_file_touches"))
