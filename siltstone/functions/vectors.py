"""Column functions over arrays of numbers, and blocked nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    length = norm(a)
    return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / length))


class Best:
    """The ``k`` best rows of each of ``n`` queries so far, kept while a task reads its rows: largest score first, smaller id where they tie."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, np.zeros((n, 0), np.int64), np.zeros((n, 0))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a row for each query and a column for each of ``ids``; minus infinity is no hit."""
        ids = np.concatenate((self.ids, np.broadcast_to(ids, scores.shape)), axis=1)
        scores = np.concatenate((self.scores, scores), axis=1)
        if scores.shape[1] > 4 * self.k:  # what is under the k-th best can't be among them
            floor = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            some = (scores >= floor[:, None]).any(axis=0)
            ids, scores = ids[:, some], scores[:, some]
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.ids, self.scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def rows(self, queries: np.ndarray) -> pa.RecordBatch:
        real = np.isfinite(self.scores)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, real.sum(axis=1))), pa.array(self.ids[real]), pa.array(self.scores[real])], ["query_id", "id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of what tasks found, with their ``rank``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, floor: float | None = None, block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, id, score, rank``: for each query the ``k`` rows with the largest cosine (ties: smaller id), then those of at least ``floor``.

    A query is not its own neighbour. The queries, a stated set, are sent to all rows in blocks of ``block``, so what is
    broadcast is bounded; each task keeps its ``k`` best per query, and only those are shuffled.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    parts = max(1, -(-asked.count() // block))
    out: DataFrame | None = None
    for part in range(parts):
        got = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()
        if not got:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.id for r in got]), _units(np.array([r.vec for r in got], np.float64))))
        found = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL").mapInArrow(_best(shared, k), "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    out = ranked(out, k)
    return out if floor is None else out.filter(F.col("score") >= floor)


def _units(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        best = Best(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                own = some.column(0).to_numpy()
                flat = some.column(1).flatten().to_numpy().astype(np.float64).reshape(len(own), -1)
                score = np.round(asked @ _units(flat).T, 9)
                score[ids[:, None] == own[None]] = -np.inf
                best.add(own, score)
        yield best.rows(ids)

    return run
