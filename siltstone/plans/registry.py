"""All registered queries of the library itself, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function ``(t) -> DataFrame`` under its name; ``t(name)`` reads a table, ``t.spark`` is the session."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def load() -> None:
    """Imports the modules that register queries."""
    for name in ("relational", "retrieval", "voting", "history", "reconcile", "statistics", "rules", "text", "logs", "edits", "replays", "versions", "unions", "folders", "changes"):
        importlib.import_module(f"siltstone.plans.{name}")



