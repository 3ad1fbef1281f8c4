"""What became of sessions: latest acceptances with what led to them, replays against what was recorded, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.stats import running


def projected(events: DataFrame, session: str, unit: str, seq: str, accepted: Column, candidate: Column, failed: Column) -> DataFrame:
    """One row per session and unit with an acceptance: ``accept_seq`` (the last), ``candidate_seq`` (the last candidate before it), ``attempts`` (all candidates) and ``verified``: nothing of the unit failed after it."""
    at = lambda c: F.when(c, F.col(seq))
    last = events.groupBy(session, unit).agg(F.max(at(accepted)).alias("accept_seq"), F.count_if(candidate).alias("attempts"), F.max(at(failed)).alias("_fail"))
    ok = last.filter("accept_seq IS NOT NULL")
    before = events.filter(candidate).select(session, unit, F.col(seq).alias("_c")).join(ok.select(session, unit, "accept_seq"), [session, unit]).filter(F.col("_c") < F.col("accept_seq"))
    made = before.groupBy(session, unit).agg(F.max("_c").alias("candidate_seq"))
    out = ok.join(made, [session, unit], "left").withColumn("verified", F.coalesce(F.col("_fail") < F.col("accept_seq"), F.lit(True)))
    return out.select(session, unit, "accept_seq", F.coalesce("candidate_seq", F.lit(-1)).alias("candidate_seq"), "attempts", "verified")


def mismatches(recorded: DataFrame, replayed: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Rows recorded or replayed under a key whose outcomes differ; one that is missing is empty."""
    a, b = recorded.select(*keys, F.col(col).alias("recorded")), replayed.select(*keys, F.col(col).alias("replayed"))
    both = a.join(b, keys, "full").withColumns({"recorded": F.coalesce("recorded", F.lit("")), "replayed": F.coalesce("replayed", F.lit(""))})
    return both.filter("recorded != replayed")


def repeats(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Contents that a key has had before: ``hash, n``."""
    return rows.groupBy(*keys, content.alias("hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def frontier(rows: DataFrame, spans: DataFrame, key: str, lo: str, hi: str, fast: Column) -> DataFrame:
    """Rows labelled ``frontier`` if their span meets one of ``spans`` (``key, lo, hi``) of their key, else by ``fast``, a fast path's name, or ``keep``.

    A span is met if, of all that start up to the row's end, the one that reaches furthest reaches the row's start: one
    ordered pass over rows and spans, dealt by ranges, in place of pairs.
    """
    own = rows.select(F.col(key).alias("_key"), F.col(hi).alias("_at"), F.struct(*rows.columns).alias("row"), F.lit(None).cast(spans.schema[hi].dataType).alias("_hi"))
    seen = spans.select(F.col(key).alias("_key"), F.col(lo).alias("_at"), F.lit(None).cast(own.schema["row"].dataType).alias("row"), F.col(hi).alias("_hi"))
    near = running(own.unionByName(seen), ["_key"], ["_at"], {"_reach": F.col("_hi")}, largest=True).filter("row IS NOT NULL").select("row.*", "_reach")
    return near.withColumn("disposition", F.when(F.col("_reach") >= F.col(lo), "frontier").otherwise(F.coalesce(fast, F.lit("keep")))).drop("_reach")
