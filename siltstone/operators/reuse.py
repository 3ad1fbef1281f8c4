"""Reuse of stored rows: the first that fits, and why earlier ones of the same shape don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reuse(asked: DataFrame, store: DataFrame) -> DataFrame:
    """``id, pos, near_misses`` for each asked row whose shape the store has.

    ``asked`` has ``id, shape, language, kind, path``; ``store`` has these but the id, and ``pos`` (its order) ``,
    evidence`` (boolean) and ``resolved``. An empty or null language, kind or path on either side fits all; a shape that is
    empty or null fits none. ``pos`` is the first row that fits, has evidence and a resolved text, null if none does;
    ``near_misses`` are the reasons, by when they first occur, of rows before it: ``language``, ``kind``, ``path``,
    ``evidence``, ``resolved``, of each row the first. Asked rows of one id are one.

    The store is reduced to what decides, with its first place, before it meets what is asked, so a shape that many rows
    share counts once for each way in which they differ.
    """
    parts = ("language", "kind", "path")
    has = {"evidence": F.coalesce("evidence", F.lit(False)), "resolved": F.coalesce(F.col("resolved") != "", F.lit(False))}
    kept = store.filter("shape != ''").select("pos", "shape", *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in parts], *[v.alias(f"_{k}") for k, v in has.items()])
    kept = kept.groupBy("shape", *[f"_{c}" for c in (*parts, *has)]).agg(F.min("pos").alias("pos"))
    want = asked.filter("shape != ''").select("id", "shape", *[F.coalesce(c, F.lit("")).alias(c) for c in parts])
    why = F.lit(None).cast("string")
    for k in reversed(list(has)):
        why = F.when(~F.col(f"_{k}"), k).otherwise(why)
    for c in reversed(parts):
        why = F.when((F.col(c) != "") & (F.col(f"_{c}") != "") & (F.col(c) != F.col(f"_{c}")), c).otherwise(why)
    met = want.join(kept, "shape").select("id", "pos", why.alias("why"))
    reasons = (*parts, *has)
    first = lambda w: F.min(F.when(F.col("why") == w, F.col("pos")))
    by = met.groupBy("id").agg(F.min(F.when(F.col("why").isNull(), F.col("pos"))).alias("pos"), *[first(w).alias(f"_{w}") for w in reasons])
    seen = F.array(*[F.when(F.col("pos").isNull() | (F.col(f"_{w}") < F.col("pos")), F.struct(F.col(f"_{w}").alias("at"), F.lit(w).alias("why"))) for w in reasons])
    ordered = F.array_sort(F.filter(seen, lambda s: s["at"].isNotNull()))
    return by.select("id", "pos", F.transform(ordered, lambda s: s["why"]).alias("near_misses"))


def refined(current: Column, base: Column, replayed: Column) -> Column:
    """The refined sides as a struct ``current, base, replayed``, null unless all are there."""
    sides = F.struct(current.alias("current"), base.alias("base"), replayed.alias("replayed"))
    return F.when(current.isNotNull() & base.isNotNull() & replayed.isNotNull(), sides)
