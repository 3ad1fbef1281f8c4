"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's windows of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import FOLD, blobs, kept, lean, slices, table, written

def windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``gram, n, item``: all windows of ``size`` consecutive words of each item, or all its words if fewer; no row for an item without words. An item without an id has its windows, with a null as item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: list[tuple[str, int, str]] = []
            for item, raw in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                words = raw.translate(FOLD).split()
                k = min(size, len(words))
                grams = {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
                out += [(g.decode(), k, item) for g in sorted(grams)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())], ["gram", "n", "item"])

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(cut, "gram string, n int, item string")


def _automaton(shared: Broadcast) -> ahocorasick.Automaton | None:
    """The automaton over one block of windows, held by a Python worker until it needs another model. Its alphabet is bytes, so offsets are byte offsets."""

    def build() -> ahocorasick.Automaton | None:
        machine = ahocorasick.Automaton()
        for gram, n, items in shared.value["grams"]:
            padded = " " + gram.encode().decode("latin-1") + " "
            machine.add_word(padded, (len(padded), n, tuple(items)))
        if not len(machine):
            return None
        machine.make_automaton()
        return machine

    return kept(("windows", shared.value["key"]), build)


def _hits(machine: ahocorasick.Automaton | None, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
    """Word intervals (merged, half open) that windows of one block cover, and their items."""
    spans: list[list[int]] = []
    items: set[str] = set()
    if machine is None or not words:
        return spans, items
    text = b" " + b" ".join(words) + b" "
    gaps = None
    for end, (length, n, of) in machine.iter(text.decode("latin-1")):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first = int(np.searchsorted(gaps, end - length + 1))
        spans.append([first, first + n])
        items.update(of)
    return merge(spans), items


def merge(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping and touching half-open intervals merged, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def offsets(raw: bytes, spans: list[list[int]]) -> list[dict]:
    """The character offsets, in the original text, of word intervals."""
    folded = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], folded.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(chars[first[a]]), "end": int(chars[last[b - 1]])} for a, b in spans]


def scan(docs: DataFrame, items: DataFrame, size: int = 10, block_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Finds every occurrence of an item's window in every document.

    Returns one row per row of ``docs``: ``doc_id, n_words, n_hit, items array<string>, spans array<struct<start,end>>``;
    spans are merged character offsets in the original text, items are sorted as strings; an item without an id is hit,
    but not listed. A null or empty text has no
    words. Without items, or with items that have no words, nothing is hit. Repeated rows are each returned.

    The automaton is sent to all executors in blocks of about ``block_bytes``: a larger benchmark is split by window
    into more blocks, which the documents then pass one after the other, so no broadcast grows with the benchmark.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast("array<struct<a:int,b:int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    final = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            *T._parse_datatype_string("n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>").fields,
        ]
    )
    blocks = list(_blocks(items, size, block_bytes, item_col, item_text_col))
    for i, shared in enumerate(blocks, 1):
        found = found.mapInArrow(_pass(shared, i == len(blocks)), final if i == len(blocks) else found.schema)
    return found


def keep_clean(docs: DataFrame, items: DataFrame, size: int = 10, block_bytes: int = 128 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs; decided where the rows are, without a shuffle. A null text has no words and stays; repeated rows are each judged; without items all rows stay; an empty table gives no rows. A larger benchmark is met in blocks, as in ``scan``."""
    at = docs.columns.index(text_col)
    for shared in _blocks(items, size, block_bytes, item_col, item_text_col):
        docs = docs.mapInArrow(_filter(shared, at), docs.schema)
    return docs


def _blocks(items: DataFrame, size: int, block_bytes: int, item_col: str, item_text_col: str) -> Iterator[Broadcast]:
    """The benchmark's distinct windows with the ids of their items, split by their hash into as many blocks as keep each under ``block_bytes`` as an automaton; one empty block if there is none."""
    grams = windows(items, size, item_col, item_text_col).groupBy("gram", "n").agg(F.array_sort(F.collect_set("item")).alias("of"))
    grams = written(grams, "windows")
    # in an automaton each byte of a window takes some 40 bytes; a window, its Python objects and ids some 60 and 60 each more
    total = grams.agg(F.sum(40 * F.octet_length("gram") + 60 + 60 * F.size("of"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        rows = grams.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block).select("gram", "n", "of").collect()
        yield items.sparkSession.sparkContext.broadcast({"key": uuid.uuid4().hex, "grams": [tuple(r) for r in rows]})


def _filter(shared: Broadcast, at: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared)
        for batch in slices(batches, at):
            yield batch.filter(pa.array([not _hits(machine, raw.translate(FOLD).split())[0] for raw in blobs(batch.column(at))], pa.bool_()))

    return run


def _pass(shared: Broadcast, last: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared)
        for batch in slices(batches, 1):
            texts = blobs(batch.column(1))
            old_hits, old_items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n_words, hits, items = [], [], []
            for raw, before, had in zip(texts, old_hits, old_items, strict=True):
                words = raw.translate(FOLD).split()
                spans, of = _hits(machine, words)
                n_words.append(len(words))
                hits.append(merge(spans + [[x["a"], x["b"]] for x in before]) if before else spans)
                items.append(sorted(of.union(had)))
            item_col = pa.array(items, pa.list_(pa.string()))
            if last:
                spans = [offsets(raw, h) if h else [] for raw, h in zip(texts, hits, strict=True)]
                cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array([sum(b - a for a, b in h) for h in hits], pa.int64()), item_col, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "items", "spans"])
            else:
                cols = [batch.column(0), batch.column(1), pa.array([[{"a": a, "b": b} for a, b in h] for h in hits], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), item_col]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "hits", "items"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the words of every document that lie in a window of a benchmark item."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM fold, sizes WHERE len(w) >= n),
hit AS (
  SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON win.n = pos.n AND win.gram = array_to_string(pos.w[pos.i : pos.i + pos.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT fold.doc_id, len(fold.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM fold LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
