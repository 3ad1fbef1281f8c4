"""Approximate nearest neighbours by learned partitions, for the largest inner product.

A bounded sample gives a neighbour graph, which is cut into balanced parts; a small network learns to say in which parts
a vector's neighbours lie. Every row goes to its most probable part, every query to several, as many as a brute-force
search for some queries over all rows shows to be needed. Rows and queries of a part meet in blocks, and what may be
among the best is scored again on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import lean, table, written


@dataclass
class Router:
    """A network with one hidden layer: for a vector, a score for each part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x.astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The ``k`` rows with the largest inner product of each row, itself not among them."""
    x = x.astype(np.float32)
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), block):
        score = x[at : at + block] @ x.T
        score[np.arange(len(score)), at + np.arange(len(score))] = -np.inf
        out[at : at + block] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, passes: int = 12) -> np.ndarray:
    """A part for each node, all equally large but for one node a halving, with few edges between parts.

    Halves are halved again: first by the median of the second eigenvector of the graph (power iteration), then nodes of
    both halves swap places as long as that saves edges, so the halves stay equal.
    """
    out = np.zeros(len(graph), np.int64)
    waiting = [(np.arange(len(graph)), 0, parts)]
    while waiting:
        nodes, first, n = waiting.pop()
        if n == 1 or len(nodes) < 2:
            out[nodes] = first
            continue
        half = n // 2
        cut = len(nodes) * half // n
        local = np.full(len(graph), -1)
        local[nodes] = np.arange(len(nodes))
        a, b = np.repeat(np.arange(len(nodes)), graph.shape[1]), local[graph[nodes]].ravel()
        a, b = a[b >= 0], b[b >= 0]
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        degree = np.bincount(a, minlength=len(nodes)) + 1.0
        v = rng.standard_normal(len(nodes))
        for _ in range(40):
            v -= (v * degree).sum() / degree.sum()
            v = v / 2 + (np.bincount(a, v[b], len(nodes)) + v) / degree / 2
            v /= np.abs(v).max() or 1.0
        left = np.zeros(len(nodes), bool)
        left[np.argsort(v, kind="stable")[:cut]] = True
        for _ in range(passes):
            on_left = np.bincount(a, left[b].astype(float), len(nodes))
            gain = np.where(left, degree - 1 - 2 * on_left, 2 * on_left - degree + 1)
            l, r = np.flatnonzero(left), np.flatnonzero(~left)
            l, r = l[np.argsort(-gain[l], kind="stable")], r[np.argsort(-gain[r], kind="stable")]
            m = min(len(l), len(r))
            swap = int((gain[l[:m]] + gain[r[:m]] > 0).sum()) // 2  # half of them, as swaps change each other's gains
            if not swap:
                break
            left[l[:swap]], left[r[:swap]] = False, True
        waiting += [(nodes[left], first, half), (nodes[~left], first + half, n - half)]
    return out


def train_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 30, rate: float = 0.01) -> Router:
    """Learns for each vector how the parts of itself and of its neighbours are spread."""
    n, d = x.shape
    x = x.astype(np.float32)
    scale = float(np.sqrt((x**2).mean())) or 1.0
    w = [rng.standard_normal((d, hidden)).astype(np.float32) / (scale * np.sqrt(d)), np.zeros(hidden, np.float32), rng.standard_normal((hidden, parts)).astype(np.float32) * 0.05, np.zeros(parts, np.float32)]
    m, s, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    near = np.concatenate((part[:, None], part[graph]), axis=1)
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            rows = order[at : at + 256]
            target = np.zeros((len(rows), parts), np.float32)
            np.add.at(target, (np.arange(len(rows))[:, None], near[rows]), 1.0 / near.shape[1])
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - target) / len(rows)
            dh = (dz @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                m[i] += 0.1 * (g - m[i])
                s[i] += 0.001 * (g * g - s[i])
                w[i] -= rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*w)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, summed from the first component on, so that equal vectors have equal scores wherever they are met."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def best(asked: np.ndarray, rows: np.ndarray, rank: np.ndarray, k: int, chunk: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the ``k`` best rows of each query; where scores tie, those of smaller ``rank`` come first."""
    out = []
    length = np.sqrt((rows**2).sum(axis=1).max(initial=0.0))
    for at in range(0, len(asked), chunk):
        some = asked[at : at + chunk]
        rough = some @ rows.T
        floor = -np.partition(-rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(some), -np.inf)
        slack = 1e-12 * np.sqrt((some**2).sum(axis=1)) * length * rows.shape[1]
        q, r = np.nonzero(rough >= (floor - slack)[:, None])
        score = exact_scores(some[q], rows[r])
        order = np.lexsort((rank[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        out.append((q[keep] + at, r[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _routed(router: Broadcast, probes: int):
    """Adds the most probable parts of each row, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = router.value.scores(_matrix(batch.column(batch.schema.get_field_index("vec"))))
            parts = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32)), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "parts"])

    return lean(run)


def _grouped(router: Broadcast, probes: int, group_of: dict[int, int]):
    """A row for each cell that holds some of a query's most probable parts, with those parts."""
    route = _routed(router, probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.full(router.value.parts, -1, np.int32)
        cells[list(group_of)] = list(group_of.values())
        for batch in route(batches):
            parts = _matrix(batch.column(2)).astype(np.int32)
            where = cells[parts]
            for cell in np.unique(where[where >= 0]):
                rows, at = np.nonzero(where == cell)
                some, counts = np.unique(rows, return_counts=True)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(parts[rows, at]))
                chosen = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1), pa.array(np.full(len(some), cell, np.int32)), lists], ["key", "vec", "cell", "parts"])

    return run


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vec, key`` of the rows that take part, one for each id: those with an id whose vector has numbers only, not all of them 0, and as many as most vectors have (the fewer where that ties). Of rows that repeat an id the smallest vector counts. ``key`` is the vector's digest."""
    v = F.col("vec")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("vec") == (most["d"] if most else 0)).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return rows.withColumn("key", F.unhex(F.sha2(F.array_join(v.cast("array<string>"), ","), 256)))


class LearnedIndex:
    """All distinct vectors of a table, each in its most probable part.

    ``sample`` bounds the vectors that graph and network are fitted to (those with the smallest digests), ``part_rows``
    is what a part should hold, ``most_parts`` bounds their number, ``asked`` the queries from which the number of parts
    to search is learned: the fewest that hold ``target`` of their true neighbours, which a brute-force search over all
    rows finds. Every row is indexed. Equal vectors are one entry, which keeps the ``k + 1`` smallest ids: no other can
    be among the ``k`` nearest of any query, as ties go to smaller ids.
    """

    def __init__(self, rows: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 16_384, part_rows: int = 1024, most_parts: int = 1024, asked: int = 256, target: float = 0.95, seed: int = 0):
        self.spark, self.k = rows.sparkSession, k
        self.rows = written(usable(rows, id_col, vec_col), "vectors")
        by = Window.partitionBy("key").orderBy("vec_id")
        ranked = self.rows.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1)
        holders = written(ranked.select("key", "vec_id", F.when(F.col("n") == 1, F.col("vec")).alias("vec")), "holders")
        self.holders, texts = holders.select("key", "vec_id"), holders.filter("vec IS NOT NULL").withColumnRenamed("vec_id", "least")
        n = texts.count()
        drawn = texts.orderBy("key").limit(sample).select("vec").toArrow()
        x = _matrix(drawn.column("vec")) if n else np.zeros((0, 1))
        parts = int(max(1, min(most_parts, n // part_rows, len(x) // 16)))
        rng = np.random.default_rng(seed)
        if parts > 1:
            graph = neighbour_graph(x, 10)
            router = train_router(x, graph, balanced_parts(graph, parts, rng), parts, rng)
        else:
            d = x.shape[1]
            router = Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
        self.router = self.spark.sparkContext.broadcast(router)
        kind = self.rows.schema["vec"].dataType.simpleString()
        self.kind = kind
        self.entries = written(texts.mapInArrow(_routed(self.router, 1), f"key binary, least long, vec {kind}, parts array<int>").withColumn("part", F.col("parts")[0]).drop("parts"), "entries")
        self.sizes = {r["part"]: r["count"] for r in self.entries.groupBy("part").count().collect()}
        self.probes, self.curve = self._calibrated(texts, asked, target)

    def _calibrated(self, texts: DataFrame, asked: int, target: float) -> tuple[int, list[float]]:
        """The number of parts to search, and the share of true neighbours that 1, 2, ... parts hold."""
        if self.router.value.parts == 1:
            return 1, [1.0]
        got = texts.orderBy(F.reverse(F.col("key").cast("string")), "key").limit(asked).select("key", "vec").toArrow()
        keys, q, k = got.column("key").to_pylist(), _matrix(got.column("vec")), self.k
        shared = self.spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rank = batch.column(1).to_numpy()
                    i, r, score = best(shared.value, _matrix(batch.column(2)), rank, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(i), batch.column(0).take(pa.array(r)), pa.array(rank[r]), batch.column(3).take(pa.array(r)), pa.array(score)], ["q", "key", "least", "part", "score"])

        found = self.entries.select("key", "least", "vec", "part").mapInArrow(lean(run), "q long, key binary, least long, part int, score double")
        w = Window.partitionBy("q").orderBy(F.desc("score"), "least")
        found = found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1).collect()
        order = np.argsort(-self.router.value.scores(q), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
        at = np.array([place[r["q"], r["part"]] for r in found if bytes(r["key"]) != bytes(keys[r["q"]])])
        shared.destroy()
        curve = [float((at <= i).mean()) for i in range(order.shape[1])] if len(at) else [1.0]
        return next((i + 1 for i, share in enumerate(curve) if share >= target), len(curve)), curve

    def _groups(self, row_block: int) -> dict[int, int]:
        """A cell for each part that has rows: neighbouring parts share one while they hold no more than ``row_block``."""
        out, group, held = {}, 0, 0
        for part in sorted(self.sizes):
            if held and held + self.sizes[part] > row_block:
                group, held = group + 1, 0
            out[part] = group
            held += self.sizes[part]
        return out

    def search(self, queries: DataFrame, probes: int | None = None, row_block: int = 8192, query_block: int = 8192) -> DataFrame:
        """``query_id, rank, vec_id, score``: the ``k`` nearest of each of ``queries`` (``vec_id, vec, key``), its own id not among them; equal scores by id.

        Equal query vectors are searched once. Parts of like numbers, which halving has put side by side, share a cell of
        about ``row_block`` rows, in which a query meets the rows of its own parts only; a larger part is cut into cells,
        and so are a cell's queries beyond ``query_block``, so no part is one task's, however large. With ``probes`` the
        number of parts, it is exact.
        """
        probes = probes or self.probes
        group_of = self._groups(row_block)
        asked = queries.groupBy("key").agg(F.first("vec").alias("vec"))
        routed = asked.mapInArrow(_grouped(self.router, probes, group_of), f"key binary, vec {self.kind}, cell int, parts array<int>")
        routed = written(routed, "routed")
        held: dict[int, int] = {}
        for part, n in self.sizes.items():
            held[group_of[part]] = held.get(group_of[part], 0) + n
        waiting = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}
        slices = {g: (-(-n // row_block), -(-waiting[g] // query_block)) for g, n in held.items() if waiting.get(g)}
        if not slices:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        of = lambda c, values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c)
        number = lambda i: of(F.col("cell"), {g: s[i] for g, s in slices.items()})
        spread = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        rows = self.entries.withColumn("cell", of(F.col("part"), group_of)).filter(F.col("cell").isin(list(slices)))
        rows = rows.select("cell", spread(number(0)).alias("a"), every(number(1)).alias("b"), "part", "key", "least", "vec")
        asks = routed.filter(F.col("cell").isin(list(slices))).select("cell", spread(number(1)).alias("b"), every(number(0)).alias("a"), "key", "vec", "parts")
        k = self.k

        def met(ask: pa.Table, row: pa.Table) -> pa.Table:
            names, types = ["asked", "key", "least", "score"], [pa.binary(), pa.binary(), pa.int64(), pa.float64()]
            if not ask.num_rows or not row.num_rows:
                return pa.table([pa.array([], t) for t in types], names)
            least, part, vectors, asked = row.column("least").to_numpy(), row.column("part").to_numpy(), _matrix(row.column("vec")), _matrix(ask.column("vec"))
            lists = ask.column("parts").combine_chunks()
            of_query, wanted = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            found = []
            for p in np.unique(part):
                q, r = of_query[wanted == p], np.flatnonzero(part == p)
                i, j, score = best(asked[q], vectors[r], least[r], k + 1)
                found.append((q[i], r[j], score))
            q, r, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((least[r], -score, q))
            order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) <= k]  # k + 1 of each query
            q, r, score = q[order], r[order], score[order]
            columns = [ask.column("key").take(pa.array(q)), row.column("key").take(pa.array(r)), pa.array(least[r]), pa.array(score)]
            return pa.table([c.cast(t) for c, t in zip(columns, types, strict=True)], names)

        cell = ["cell", "a", "b"]
        found = asks.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(met, "asked binary, key binary, least long, score double")
        w = Window.partitionBy("asked").orderBy(F.desc("score"), "least")
        found = found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1).select("asked", "key", "score")
        w = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
        ids = found.join(self.holders, "key").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
        lists = ids.groupBy(F.col("asked").alias("key")).agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
        near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        out = queries.select(F.col("vec_id").alias("query_id"), "key").join(written(lists, "near"), "key").select("query_id", F.posexplode(near).alias("rank", "hit"))
        return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def nearest(rows: DataFrame, chosen: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", **options: object) -> DataFrame:
    """The ``k`` nearest of every row that is ``chosen`` (a condition on ``vec_id``), among all others. An empty table gives no rows; see ``usable`` for rows that take no part."""
    index = LearnedIndex(rows, k, id_col, vec_col, **options)
    return index.search(index.rows.filter(chosen))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the 20 nearest of every vector whose id 20 divides."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
