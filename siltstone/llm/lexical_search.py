"""Ranked lexical search over dual-sorted wavelet trees, one for each shard of the documents.

A shard's postings are one sequence of documents: term after term, each term's by falling impact. The wavelet tree over
that sequence splits the documents in halves, level by level, and keeps the order in each half; so a term's range in any
node starts with its largest impact among the documents below, and following all terms' ranges down finds documents by
id. A search takes the nodes whose bound (the sum of these largest impacts) is best, until none can beat what it has.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import FOLD, blobs, lean, scratch, slices, table, written

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 4 << 20
#: Bytes of items that are sent to the tasks at a time.
BLOCK = 16 << 20


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return [t for t in text.translate(FOLD).split(b" ") if t]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term gives before its weight; ``m`` is a document's measure of length."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def length_measure(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """75 for an empty document, 100 for one of mean length."""
    return 100 - 25 + (25 * n * documents) // max(total, 1)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Tree:
    """A wavelet tree without pointers over ``docs`` (numbers below ``n_docs``): at each level the bits of all entries in
    the order of that level, zeros before ones; ``zeros`` counts them, so a range is followed down by two look-ups."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.zeros = [np.concatenate(([0], np.cumsum(~bits, dtype=np.int32))).astype(np.int32) for bits in levels]

    @classmethod
    def of(cls, docs: np.ndarray, n_docs: int) -> Tree:
        levels = []
        for shift in reversed(range(max(1, (n_docs - 1).bit_length()))):
            bits = (docs >> shift & 1).astype(bool)
            levels.append(bits)
            docs = np.concatenate((docs[~bits], docs[bits]))
        return cls(levels)

    def down(self, values: np.ndarray) -> list[np.ndarray]:
        """The values of the entries in the order of each level, and of the leaves."""
        out = [values]
        for bits in self.levels:
            values = np.concatenate((values[~bits], values[bits]))
            out.append(values)
        return out

    def halves(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where places of a level are among the zeros and among the ones of the next."""
        z = self.zeros[level][at]
        return z, at - z + self.zeros[level][-1]

    def pack(self) -> list[bytes]:
        return [np.packbits(bits).tobytes() for bits in self.levels]

    @classmethod
    def unpack(cls, packed: list[bytes], n: int) -> Tree:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b in packed])


def shard(ids: list[int | None], texts: list[bytes], documents: int, total: int) -> dict | None:
    """The index of some documents; None if none of them has a term. Documents are numbered by id (a null id first), so smaller numbers are smaller ids."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    number: dict[bytes, int] = {}
    term, tf, doc, n = [], [], [], np.zeros(len(ids), np.int64)
    for at, i in enumerate(order):
        found = Counter(terms(texts[i]))
        n[at] = found.total()
        term.append(np.array([number.setdefault(t, len(number)) for t in found], np.int32))
        tf.append(np.fromiter(found.values(), np.int64, len(found)))
        doc.append(np.full(len(found), at, np.int32))
    if not number:
        return None
    names = sorted(number)
    rank = np.empty(len(names), np.int32)
    rank[[number[t] for t in names]] = np.arange(len(names))
    term, tf, doc = rank[np.concatenate(term)], np.concatenate(tf), np.concatenate(doc)
    best = np.lexsort((doc, -impact(tf, length_measure(n, documents, total)[doc]), term))
    tree = Tree.of(doc[best], len(ids))
    return {"ids": [ids[i] for i in order], "lengths": n.astype("<i4").tobytes(), "terms": b"\n".join(names), "counts": np.bincount(term, minlength=len(names)).astype("<i4").tobytes(), "bits": tree.pack(), "tf": tf[best].astype("<i4").tobytes()}


_SHARD = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("bits", pa.list_(pa.binary())), ("tf", pa.binary())])
_SHARD_DDL = "ids array<long>, lengths binary, terms binary, counts binary, bits array<binary>, tf binary"


@dataclass
class Index:
    """``shards`` (a row each), the number of documents with terms, and of all their terms."""

    shards: DataFrame
    documents: int
    total: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shard_bytes: int = SHARD) -> Index:
    """Indexes whole texts; null is empty. Shards are slices of what each task reads, so nothing is shuffled; texts are read twice, as impacts need the mean length. Rows that repeat an id are documents of their own."""
    spark, rows = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for text in blobs(batch.column(0)):
                words = len(terms(text))
                n, total = n + (words > 0), total + words
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    whole = rows.select("text").mapInArrow(lean(sizes), "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    documents, total = whole["n"] or 0, whole["total"] or 0

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in slices(batches, 1, shard_bytes):
            for i, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                if size and size + len(text) > shard_bytes:
                    yield from _rows(shard(ids, texts, documents, total))
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield from _rows(shard(ids, texts, documents, total))

    path = path or scratch(spark, "shards")
    rows.mapInArrow(lean(indexed), _SHARD_DDL).write.parquet(path)
    return Index(spark.read.schema(_SHARD_DDL).parquet(path), documents, total)


def _rows(made: dict | None) -> Iterator[pa.RecordBatch]:
    if made is not None:
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in made.items()}, _SHARD)


def _best_first(tree: Tree, impacts: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int, floor: int, batch: int = 256) -> list[tuple[int, int]]:
    """The ``k`` best ``(score, number)`` of a shard that score at least ``floor``; of equal ones all that may be among them."""
    depth = len(tree.levels)
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None] = [None] * (depth + 1)
    have = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bound(level: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        values = impacts[level]
        return (weights * np.where(lo < hi, values[np.minimum(lo, len(values) - 1)], 0)).sum(axis=1)

    waiting[0] = (bound(0, lo[None], hi[None]), lo[None], hi[None], np.zeros(1, np.int64))
    while True:
        tops = [int(w[0].max()) if w is not None and len(w[0]) else -1 for w in waiting[:depth]]
        level = max(range(depth), key=lambda i: (tops[i], i))
        if tops[level] < max(floor, 1):
            break
        score, lo, hi, prefix = waiting[level]
        alive = score >= max(floor, 1)
        if len(score) > batch:
            cut = -np.partition(-score, batch - 1)[batch - 1]
            now = alive & (score >= cut)
        else:
            now = alive
        later = alive & ~now
        waiting[level] = (score[later], lo[later], hi[later], prefix[later])
        lo, hi, prefix = lo[now], hi[now], prefix[now]
        (lo0, lo1), (hi0, hi1) = tree.halves(level, lo), tree.halves(level, hi)
        lo, hi, prefix = np.concatenate((lo0, lo1)), np.concatenate((hi0, hi1)), np.concatenate((2 * prefix, 2 * prefix + 1))
        score = bound(level + 1, lo, hi)
        fine = score >= max(floor, 1)
        score, lo, hi, prefix = score[fine], lo[fine], hi[fine], prefix[fine]
        if level + 1 < depth:
            old = waiting[level + 1]
            waiting[level + 1] = (score, lo, hi, prefix) if old is None or not len(old[0]) else tuple(np.concatenate(x) for x in zip(old, (score, lo, hi, prefix), strict=True))
        elif len(score):
            have = np.concatenate((have[0], score)), np.concatenate((have[1], prefix))
            order = np.lexsort((have[1], -have[0]))[:k]
            have = have[0][order], have[1][order]
            if len(have[0]) == k:
                floor = max(floor, int(have[0][-1]))
    return list(zip(have[0].tolist(), have[1].tolist(), strict=True))


def search(index: Index, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score for each item, equal scores by id.

    Items are sent to the tasks in blocks of bounded size; each task goes through its shards, keeps its ``k`` best of each
    item, and passes over what can't beat them. Only those are shuffled. Items without terms, or whose terms no document
    has, give no rows. Each row of a repeated item id is answered; a null id is an id. Null documents' ids come first.
    """
    spark = items.sparkSession
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    asked = written(asked.withColumn("row", F.monotonically_increasing_id()), "items")
    kind = asked.schema["item_id"].dataType.simpleString()
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // block)
    best = []
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "text").collect() if blocks > 1 else asked.select("row", "text").collect()
        wanted = [(r["row"], Counter(terms(r["text"].encode()))) for r in part]
        names = sorted({t for _, c in wanted for t in c})
        if not names:
            continue
        shared = spark.sparkContext.broadcast(names)
        counted = index.shards.select("terms", "counts").mapInArrow(lean(_frequencies(shared)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        weights = {names[r["term"]]: weight(r["n"], index.documents) for r in counted}
        shared.destroy()
        questions = [(row, {t: c * weights[t] for t, c in terms_.items() if weights.get(t, 0) > 0}) for row, terms_ in wanted]
        questions = [q for q in questions if q[1]]
        if questions:
            ask = spark.sparkContext.broadcast(questions)
            found = index.shards.mapInArrow(lean(_answers(ask, index.documents, index.total, k)), "row long, doc_id long, score long")
            w = Window.partitionBy("row").orderBy(F.desc("score"), "doc_id")
            best.append(written(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "best"))
            ask.destroy()
    if not best:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = best[0]
    for more in best[1:]:
        out = out.unionByName(more)
    return out.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _numbers(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<i4").astype(np.int64)


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {t: i for i, t in enumerate(shared.value)}
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for t, n in zip(batch.column(0)[i].as_py().split(b"\n"), _numbers(batch.column(1)[i]).tolist(), strict=True):
                    at = names.get(t)
                    if at is not None:
                        total[at] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    return run


def _answers(ask, documents: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = ask.value
        have: list[list[tuple[int, int | None]]] = [[] for _ in questions]
        names = {t for _, q in questions for t in q}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                ids = row["ids"].as_py()
                counts = _numbers(row["counts"])
                end = np.cumsum(counts, dtype=np.int64)
                where = {t: j for j, t in enumerate(row["terms"].as_py().split(b"\n")) if t in names}
                tf = _numbers(row["tf"])
                tree = Tree.unpack(row["bits"].as_py(), len(tf))
                m = length_measure(_numbers(row["lengths"]), documents, total)
                order = np.arange(len(tf))
                docs = np.empty(len(tf), np.int64)
                for bits in tree.levels:
                    order = np.concatenate((order[~bits], order[bits]))
                docs[order] = _leaf_numbers(tree)
                impacts = tree.down(impact(tf, m[docs]))
                for (_, weights), mine in zip(questions, have, strict=True):
                    asked = [(where[t], w) for t, w in weights.items() if t in where]
                    if not asked:
                        continue
                    at = np.array([j for j, _ in asked])
                    floor = mine[-1][0] if len(mine) == k else 1
                    got = _best_first(tree, impacts, (end - counts)[at], end[at], np.array([w for _, w in asked], np.int64), m, k, floor)
                    if got:
                        mine += [(s, ids[d]) for s, d in got]
                        mine.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
                        del mine[k:]
        out = [(row, d, s) for (row, _), mine in zip(questions, have, strict=True) for s, d in mine]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "doc_id", "score"])

    return run


def _leaf_numbers(tree: Tree) -> np.ndarray:
    """The document of each entry in the order of the leaves."""
    number = np.zeros(len(tree.levels[0]), np.int64)
    for bits in tree.levels:
        number = np.concatenate((2 * number[~bits], 2 * number[bits] + 1))
    return number


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the 20 best documents for each benchmark item."""
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE = """
WITH words AS (
  SELECT d.doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents d),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, docs),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
