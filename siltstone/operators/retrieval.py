"""Ranked retrieval: BM25, fusion of two rankings, quality filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import STOPWORDS, ident_parts, ident_tokens
from siltstone.functions.vectors import Best, ranked


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, block: int = 4096, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``query_id, id, score, rank``: for each query the ``k`` documents with the largest scores (ties: smaller id), of those with a term of the query.

    Statistics are those of all documents. A term that a query repeats counts as often. Rounded to nine digits, as sums
    of doubles depend on their order. Rows without an id aren't found, and count in the statistics.

    The queries, a stated set, are sent to all documents in blocks of ``block``. Documents are read twice for a block,
    once for the statistics of its terms and once for the scores, and nothing of them is shuffled but each task's counts
    and its ``k`` best per query.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_text).alias("text")).filter("query_id IS NOT NULL")
    parts = max(1, -(-asked.count() // block))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), ident_parts(F.col(text_col)).alias("parts"))
    out: DataFrame | None = None
    for part in range(parts):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        terms = some.select("query_id", F.explode(ident_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")).collect()
        if not terms:
            continue
        names = sorted({r.term for r in terms})
        shared = spark.sparkContext.broadcast(names)
        counted = rows.mapInArrow(_term_counts(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        known = {r.term: r.n for r in counted}  # -1: documents, -2: their terms
        n = known.get(-1, 0)
        df = np.array([known.get(i, 0) for i in range(len(names))], np.float64)
        ids, inverse = np.unique(np.array([r.query_id for r in terms]), return_inverse=True)
        place = {t: i for i, t in enumerate(names)}
        column = np.array([place[r.term] for r in terms])
        weight = np.array([r.qf for r in terms]) * np.log(1 + (n - df + 0.5) / (df + 0.5))[column]
        model = spark.sparkContext.broadcast((names, ids, inverse, column, weight, known.get(-2, 0) / max(1, n) or 1.0))
        found = rows.filter("id IS NOT NULL").mapInArrow(_term_scores(model, k, k1, b), "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    return ranked(out, k)


def _coded(parts: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of identifier parts: each list's number of terms, and list and number in ``names`` of each term that is there."""
    term = pc.utf8_lower(parts.flatten())
    own = np.asarray(pc.list_parent_indices(parts))
    keep = pc.and_(pc.greater(pc.utf8_length(term), 1), pc.invert(pc.or_(pc.match_substring_regex(term, "^[0-9]"), pc.is_in(term, pa.array(STOPWORDS)))))
    keep = np.asarray(keep, bool)
    code = np.asarray(pc.index_in(term, names).fill_null(-1))
    some = keep & (code >= 0)
    return np.bincount(own[keep], minlength=len(parts)), own[some], code[some]


def _distinct(own: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of list and term, and how often each occurs."""
    pair, times = np.unique(own.astype(np.int64) * n + code, return_counts=True)
    return pair // n, pair % n, times


def _term_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        df, rows, total = np.zeros(len(names), np.int64), 0, 0
        for batch in batches:
            length, own, code = _coded(batch.column(1), names)
            df += np.bincount(_distinct(own, code, len(names))[1], minlength=len(names))
            rows, total = rows + batch.num_rows, total + int(length.sum())
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((met, [-1, -2])), pa.int32()), pa.array(np.concatenate((df[met], [rows, total])), pa.int64())], ["term", "n"])

    return run


def _term_scores(model, k: int, k1: float, b: float, cells: int = 1 << 22):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, query, column, weight, avgdl = model.value
        order = np.argsort(column, kind="stable")  # a term's queries side by side
        query, weight = query[order], weight[order]
        start = np.searchsorted(column[order], np.arange(len(names) + 1))
        terms, best = pa.array(names, pa.string()), Best(len(ids), k)
        step = max(1, cells // len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                length, own, code = _coded(some.column(1), terms)
                own, code, tf = _distinct(own, code, len(names))
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.maximum(length, 1)[own] / avgdl))
                score = np.zeros(len(ids) * some.num_rows)
                for lo in range(0, len(own), cells // 16):
                    a, z = start[code[lo : lo + cells // 16]], start[code[lo : lo + cells // 16] + 1]
                    times = z - a
                    near = np.repeat(a - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
                    score += np.bincount(query[near] * some.num_rows + np.repeat(own[lo : lo + cells // 16], times), weight[near] * np.repeat(part[lo : lo + cells // 16], times), len(score))
                score = np.round(score, 9).reshape(len(ids), -1)
                best.add(some.column(0).to_numpy(), np.where(score > 0, score, -np.inf))
        yield best.rows(ids)

    return run


def top(scores: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "id") -> DataFrame:
    """The ``k`` best rows of each key with their ``rank`` from 1; ties go to the smaller id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def boosted(scores: DataFrame, k: int, same: Column, factor: float = 1.1) -> DataFrame:
    """Top ``k`` after a boost of the rows where ``same`` holds, inside the first ``2 * k`` of each query: nothing from further down can move up."""
    pool = top(scores.filter(F.col("score") > 0), 2 * k).drop("rank")
    return top(pool.withColumn("score", F.when(same, F.col("score") * factor).otherwise(F.col("score"))), k)


def reciprocal(rows: DataFrame, depth: int = 60) -> Column:
    """Reciprocal rank: the first place counts 1 / depth."""
    return 1 / (depth + rows["rank"] - 1)


def robust(ranked: DataFrame) -> DataFrame:
    """``query_id, id, part``: scores as clipped distances from the median in median absolute deviations, moved to 0..1; 1 for all where there is no spread."""
    whole = Window.partitionBy("query_id")
    rows = ranked.withColumn("mid", F.percentile("score", 0.5).over(whole))
    rows = rows.withColumn("mad", F.percentile(F.abs(F.col("score") - F.col("mid")), 0.5).over(whole))
    z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col("score") - F.col("mid")) / F.col("mad")))
    return rows.select("query_id", "id", F.when(F.col("mad") <= 0, F.lit(1.0)).otherwise((z + 3) / 6).alias("part"))


def fused(a: DataFrame, b: DataFrame, k: int, method: str = "rrf", weight: float = 0.5) -> DataFrame:
    """Two rankings (``query_id, id, score, rank``) as one: each gives its own best only; who misses in one counts 0 there. Ties go to the smaller id."""
    if method == "rrf":
        x, y = (r.select("query_id", "id", reciprocal(r).alias(n)) for r, n in ((a, "x"), (b, "y")))
        total = F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))
    else:
        x, y = robust(a).withColumnRenamed("part", "x"), robust(b).withColumnRenamed("part", "y")
        total = weight * F.coalesce("x", F.lit(0.0)) + (1 - weight) * F.coalesce("y", F.lit(0.0))
    return top(x.join(y, ["query_id", "id"], "full").select("query_id", "id", F.round(total, 9).alias("score")), k)


def filtered(ranked: DataFrame, facts: DataFrame, floor: float, most: int, k: int) -> DataFrame:
    """Rows with a score of at least ``floor`` and at most ``most`` retries in ``facts`` (``id, retries``; missing: too many), then the ``k`` best."""
    rows = ranked.drop("rank").join(facts, "id", "left")
    return top(rows.filter((F.col("score") >= floor) & (F.coalesce("retries", F.lit(1 << 30)) <= most)), k)
