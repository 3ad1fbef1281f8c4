"""A byte-level convolutional network in numpy that scores the quality of whole texts.

A text is cut into overlapping chunks of bytes that cover all of it. In each chunk, bytes are embedded and learned filters
run over windows of bytes; each filter's largest value is kept (max-pooling), and a small hidden layer mixes them. A
text's mean and maximum over chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import blobs, lean, slices, table

CHUNK, OVERLAP, STRIDE, DIM, HIDDEN = 256, 16, 4, 8, 16


def crc(id_col: str) -> Column:
    """CRC-32 of an id's decimal text; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, first)``: chunks of all texts as rows, padded with zeros, and the first chunk of each text (length + 1 values). An empty text has one chunk."""
    size = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP)))
    first = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(len(texts)), n)
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    start = base[owner] + (np.arange(len(owner)) - first[owner]) * (CHUNK - OVERLAP)
    data = np.frombuffer(b"".join([*texts, bytes(CHUNK)]), np.uint8)
    out = np.lib.stride_tricks.sliding_window_view(data, CHUNK)[np.minimum(start, len(data) - CHUNK)]
    left = (base + size)[owner] - start
    short = np.flatnonzero(left < CHUNK)
    out[short] *= np.arange(CHUNK) < left[short, None]
    return out, first


@dataclass
class Network:
    """Embedding (256 x DIM), filters over two strides of bytes (2 * STRIDE * DIM x filters) and biases, hidden layer and biases, weights of mean and maximum, bias."""

    emb: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    mix: np.ndarray
    mix_bias: np.ndarray
    out: np.ndarray
    off: np.ndarray

    @classmethod
    def new(cls, filters: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(draw(0.5, 256, DIM), draw(0.15, 2 * STRIDE * DIM, filters), np.zeros(filters, np.float32), draw(0.25, filters, HIDDEN), np.full(HIDDEN, 0.1, np.float32), draw(0.2, 2 * HIDDEN), np.zeros(1, np.float32))

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        return self.emb[rows].reshape(len(rows), CHUNK // STRIDE, STRIDE * DIM)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Each filter's largest value in each chunk, 256 chunks at a time."""
        half = STRIDE * DIM
        found = []
        for i in range(0, len(rows), 256):
            x = self._windows(rows[i : i + 256])
            found.append((x[:, :-1] @ self.filters[:half] + x[:, 1:] @ self.filters[half:]).max(axis=1))
        return np.maximum(np.concatenate(found) + self.bias, 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability that each text is of good quality."""
        if not texts:
            return np.zeros(0)
        rows, first = chunks(texts)
        return self._combined(np.maximum(self.pooled(rows) @ self.mix + self.mix_bias, 0), first)[1]

    def _combined(self, hidden: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(first)[:, None]
        both = np.concatenate((np.add.reduceat(hidden, first[:-1]) / n, np.maximum.reduceat(hidden, first[:-1])), axis=1)
        z = np.clip((both @ self.out + self.off).astype(np.float64), -30, 30)
        return both, 1 / (1 + np.exp(-z))

    def gradients(self, rows: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss of a batch of texts."""
        half, k = STRIDE * DIM, HIDDEN
        x = self._windows(rows)
        value = x[:, :-1] @ self.filters[:half] + x[:, 1:] @ self.filters[half:]
        at = value.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(value, at[:, None], 1)[:, 0] + self.bias, 0)
        hidden = np.maximum(pooled @ self.mix + self.mix_bias, 0)
        both, p = self._combined(hidden, first)
        g = ((p - label) * weight / weight.sum()).astype(np.float32)
        owner = np.repeat(np.arange(len(label)), np.diff(first))
        g_hidden = (g[owner, None] * (self.out[:k] / np.diff(first)[owner, None] + self.out[k:] * (hidden == both[owner, k:])) * (hidden > 0)).astype(np.float32)
        g_pool = g_hidden @ self.mix.T * (pooled > 0)
        c = np.arange(len(rows))[:, None]
        best = np.concatenate((x[c, at], x[c, at + 1]), axis=2)  # chunk, filter, window
        g_filters = np.einsum("cfw,cf->wf", best, g_pool)
        g_window = (g_pool[:, :, None] * self.filters.T[None]).reshape(-1, 2 * STRIDE, DIM)
        letters = rows[c[..., None], (at * STRIDE)[..., None] + np.arange(2 * STRIDE)].reshape(-1)
        g_emb = np.stack([np.bincount(letters, g_window.reshape(-1, DIM)[:, d], 256) for d in range(DIM)], axis=1)
        return [g_emb.astype(np.float32), g_filters, g_pool.sum(0), pooled.T @ g_hidden, g_hidden.sum(0), both.T @ g, g.sum(keepdims=True)]


def train(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, filters: int = 32, epochs: int = 14, batch: int = 48, rate: float = 0.02, seed: int = 7) -> Network:
    """Fits a network to texts that are given as their chunks, with Adam and a falling rate; deterministic."""
    net = Network.new(filters, seed)
    rng = np.random.default_rng(seed)
    names = ("emb", "filters", "bias", "mix", "mix_bias", "out", "off")
    m = [np.zeros_like(getattr(net, n)) for n in names]
    v = [np.zeros_like(x) for x in m]
    step, last = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            pick = order[i : i + batch]
            first = np.concatenate(([0], np.cumsum([len(rows[j]) for j in pick])))
            step += 1
            for j, g in enumerate(net.gradients(np.concatenate([rows[j] for j in pick]), first, labels[pick], weights[pick])):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                scale = rate * (1 - step / (last + 1)) / (1 - 0.9**step)
                setattr(net, names[j], getattr(net, names[j]) - scale * m[j] / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-7))
    return net


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1200, bytes_per_label: int = 3 << 20, fold: int = 1, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Learns from all of the texts of a bounded sample of labelled documents outside the held-out fold.

    The bound: at most ``per_label`` documents of each label and ``bytes_per_label`` bytes of text, in the order of a
    hash of their ids; a document that would go over the bytes is left out. Each label's documents are weighted so that
    the labels count as often as in all labelled rows. Without labels the network is untrained; with one label only, it
    learns that label. Null and other labels than 0 and 1 are left out; a null text counts as empty; rows that repeat an
    id are each learned.
    """
    rows = labels.filter((F.pmod(crc(id_col), F.lit(folds)) != fold) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Network.new(32, 7)
    # by a share of the hashes some more than are needed are drawn, in all tasks alike
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000_007))
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, 1.5 * per_label / n + 50 / n))])
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < share[F.col("label")] * 1_000_000_007)  # about 3 * per_label narrow rows: broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "id")
    sizes = texts.select("id", "label", "draw", F.octet_length("text").alias("size")).collect()
    left = {label: [per_label, bytes_per_label] for label in counts}
    chosen = set()
    for r in sorted(sizes, key=lambda r: (r["draw"], str(r["id"]), r["label"], r["size"])):
        room = left[r["label"]]
        if room[0] and r["size"] <= room[1]:
            room[0] -= 1
            room[1] -= r["size"]
            chosen.add((r["id"], r["label"], r["size"]))
    kinds = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("label int, size int").fields])
    wanted = F.broadcast(docs.sparkSession.createDataFrame(sorted(chosen, key=str), kinds))
    got = texts.withColumn("size", F.octet_length("text")).join(wanted, ["id", "label", "size"]).select("id", "label", "text").collect()
    got.sort(key=lambda r: (str(r["id"]), r["text"]))
    if not got:
        return Network.new(32, 7)
    label = np.array([r["label"] for r in got], np.float64)
    weight = np.array([counts[r["label"]] / max(1, sum(label == r["label"])) for r in got])
    rows_, first = chunks([r["text"].encode("utf-8", "surrogatepass") for r in got])
    return train([rows_[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], label, weight / weight.mean())


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row from its whole text; a null text counts as empty. Repeated rows are each returned, an empty table gives no rows. Other columns are not read."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            p = net.score(blobs(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the network predicts to be good; decided where the rows are, without a shuffle. A null text is judged as an empty one; repeated rows are each judged; an empty table gives no rows."""
    at = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 1 << 20):
            yield batch.filter(pa.array(net.score(blobs(batch.column(at))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the quality of every document, learned from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", (F.pmod(crc("doc_id"), F.lit(3)) == 1).alias("held_out"), "score", "predicted")
