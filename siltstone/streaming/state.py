"""Keyed state carried over passes, which outlives restarts of the stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = "session string, item string, n long, passes long"


class _Counts(StatefulProcessor):
    """Per session a map of items to how often they were seen, and the number of passes with news of it."""

    def __init__(self, expires_ms: int | None):
        self.expires_ms = expires_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "item string", "n long", self.expires_ms)
        self.passes = handle.getValueState("passes", "n long", self.expires_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news: dict[str, int] = {}
        for part in rows:
            for item, n in part.iloc[:, -1].value_counts().items():  # by place, as the optimizer may rename a plain column back
                news[item] = news.get(item, 0) + int(n)
        passes = (self.passes.get()[0] if self.passes.exists() else 0) + 1
        self.passes.update((passes,))
        out = []
        for item, n in news.items():
            n += self.seen.getValue((item,))[0] if self.seen.containsKey((item,)) else 0
            self.seen.updateValue((item,), (n,))
            out.append((key[0], item, n, passes))
        yield pd.DataFrame(out, columns=["session", "item", "n", "passes"])

    def close(self) -> None:
        pass


def carried(stream: DataFrame, session: str, item: str, expires_ms: int | None = None) -> DataFrame:
    """``session, item, n, passes``: for each item that a micro-batch has of a session how often the session has had it so far, over all passes, and the number of passes with news of the session.

    State is a map for each session, one entry an item, so an update writes an entry and not the map; entries that aren't
    touched for ``expires_ms`` are dropped. Null items aren't counted, null sessions have no state and are left out. The
    query has to be started within ``keyed_state``.
    """
    rows = stream.filter(F.col(session).isNotNull() & F.col(item).isNotNull()).select(F.col(session).cast("string").alias("_session"), F.col(item).cast("string").alias("_item"))
    return rows.groupBy("_session").transformWithStateInPandas(_Counts(expires_ms), COUNTS, "Append", "ProcessingTime" if expires_ms else "None")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in a store with keyed columns; the session's own setting is put back afterwards."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


def pass_over(spark: SparkSession, stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Reads all that is there, appends what comes out to the Parquet folder ``sink``, and stops; the next pass goes on from ``checkpoint``."""
    with keyed_state(spark):
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
