"""Folds of event journals, over whole logs and over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.stats import running


def by_step(events: DataFrame, session: str, seq: str, starts: Column, counts: dict[str, Column]) -> DataFrame:
    """Events counted under the step that started last before them: ``session, step, <counts>``; those before the first step are left out.

    Steps are numbered by a running count in each session, dealt by ranges: a long session is many tasks.
    """
    rows = running(events, [session], [seq], {"step": starts.cast("long")}).filter("step > 0")
    return rows.groupBy(session, "step").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def sessions_of(events: DataFrame, user: str, at: str, gap: str) -> DataFrame:
    """Stretches of events of a user with no gap as long as ``gap``: ``user, start, end, n``. Works on streams with a watermark."""
    got = events.groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return got.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed(events: DataFrame, at: str, width: str, slide: str | None, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums in time windows; on a stream, events later than ``late`` are dropped and windows are final after it."""
    rows = events.withWatermark(at, late) if late else events
    got = rows.groupBy(F.window(at, width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


DRIFT = "session string, n long, n_regressed long, last_commit long"
DRIFT_STATE = "n long, n_regressed long, last_commit long"


def drift_monitor(stream: DataFrame, session: str = "session", commit: str = "commit", regressed: str = "regressed", exempt: str = "exempt") -> DataFrame:
    """Running totals per session of a stream of observations: how many there were, and regressed tests outside exempt mechanisms.

    State is three numbers a session, kept in the stream's checkpoint. One row a session comes out for each micro-batch that
    has news of it. A null commit counts, but is no commit (-1 where a session has none).
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, bad, last = state.get if state.exists else (0, 0, -1)
        for part in parts:
            n += len(part)
            bad += int(part.loc[~part[exempt].fillna(False).astype(bool), regressed].fillna(0).sum())
            last = max([last, *part[commit].dropna().astype(int)])
        state.update((n, bad, last))
        yield pd.DataFrame({"session": [key[0]], "n": [n], "n_regressed": [bad], "last_commit": [last]})

    return stream.groupBy(session).applyInPandasWithState(fold, DRIFT, DRIFT_STATE, "update", "NoTimeout")


def best_so_far(stream: DataFrame, keys: list[str], score: str, setting: str) -> DataFrame:
    """The best score of each key and a setting that has it, kept up to date on a stream."""
    return stream.groupBy(*keys).agg(F.max(score).alias("best"), F.max_by(setting, score).alias("setting"), F.count(F.lit(1)).alias("n"))


def on_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch to ``handle`` exactly as often as the checkpoint says; everything that is there is read, then it stops."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_unseen(batch: DataFrame, path: str, key: str) -> None:
    """A ``handle`` that appends rows whose key the table at ``path`` doesn't have yet; a batch that is handed over twice adds nothing the second time."""
    from siltstone.sources.sinks import append

    spark = batch.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = batch.dropDuplicates([key])
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    append(fresh, path, "parquet")
