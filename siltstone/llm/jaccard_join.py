"""Near-duplicate join on word shingles by the chosen-path method.

Sets of five-word shingles are embedded as minhash tokens. In each of several runs a set follows every token that a seeded
hash selects (1 / similarity tokens in expectation), so similar sets land in the same bucket; buckets that are still
large are split again on the next selected tokens, small ones are compared by brute force. Pairs that look similar
enough there only say which documents to compare: documents so connected are then compared exactly, block by block, and only
blocks whose sets' sizes allow a link. No step writes out pairs: a bucket gives a tree of edges, a block gives each
document's number of links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import blobs, gathered, lean, perhaps, sized, slices, splitmix, table, written
from siltstone.llm.components import components
from siltstone.llm.exact_dedup import settled
from siltstone.llm.shingles import distinct, hashed

TOKENS = 64
MULTIPLY = splitmix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
ADD = splitmix(np.arange(1001, TOKENS + 1001, dtype=np.uint64))
#: Rows of a bucket that are compared in one go.
LIMIT = 2048
#: Splits for which the first runs are enough.
SHALLOW = 2
#: A block of sets to compare has BLOCK rows; those of a group of over 16 * BLOCK rows have more, up to MOST, and none has over BYTES of shingles.
BLOCK, MOST, BYTES = 256, 2048, 8 << 20


def chance(similarity: float, embedded: float, depth: int) -> float:
    """Probability that two sets meet after ``depth`` splits in one run; each selects a shared token 1 / similarity * embedded times in expectation."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-embedded / similarity * p)
    return p


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs until a pair at the threshold has been met with probability ``recall``, even if all buckets are split ``depth`` times."""
    return math.ceil(math.log(1 - recall) / math.log(1 - chance(similarity, similarity, depth)))


def text_key(c: Column) -> Column:
    """The MD5 of a text as it is (null: empty), which with a document's id tells a row."""
    return F.unhex(F.md5(F.coalesce(c, F.lit("")).cast("binary")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, copy_key, sketch, short`` of each whole text: MD5 of the text, MD5 of its folded words, 64 minhash values of its shingles and the lowest byte of each (null without words). The id keeps its type."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 2 << 20):
            hashes, first, words, keys = hashed(blobs(batch.column(2)))
            sketch: list[bytes | None] = [None] * batch.num_rows
            short: list[bytes | None] = [None] * batch.num_rows
            full = np.flatnonzero(words)
            if len(full):
                low = np.empty((len(full), TOKENS), np.uint32)
                with np.errstate(over="ignore"):
                    for j in range(TOKENS):
                        low[:, j] = np.minimum.reduceat(hashes * MULTIPLY[j] + ADD[j], first[full]) >> np.uint64(32)
                for row, i in enumerate(full):
                    sketch[i] = low[row].tobytes()
                    short[i] = low[row].astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary()), pa.array(short, pa.binary())], ["doc_id", "digest", "copy_key", "sketch", "short"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("digest binary, copy_key binary, sketch binary, short binary").fields]))


def _selected(sketches: np.ndarray, seeds: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and next keys: for each row, the tokens that the hash seeded with its path selects."""
    with np.errstate(over="ignore"):
        token = splitmix(sketches.astype(np.uint64) + (np.arange(1, TOKENS + 1, dtype=np.uint64) << np.uint64(33)))
        drawn = splitmix(token ^ splitmix(seeds)[:, None])
        row, at = np.nonzero(drawn < np.uint64(int(2**64 / (similarity * TOKENS))))
        return row, splitmix(token[row, at] + splitmix(seeds[row] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def _split(runs: range, similarity: float) -> Callable:
    """Rows ``node, sketch, key, size`` to ``node, key, within`` of the next level, ``within`` being the size of the bucket that is split; a null key starts all ``runs``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            nodes = batch.column(0).to_numpy()
            sketches = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
            if batch.column(2).null_count:
                starts = [np.full(len(nodes), seed, np.uint64) for seed in splitmix(np.array(runs, np.uint64) + np.uint64(1))]
            else:
                starts = [batch.column(2).to_numpy().view(np.uint64)]
            for seeds in starts:
                row, key = _selected(sketches, seeds, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[row]), pa.array(key.view(np.int64)), batch.column(3).take(pa.array(row))], ["node", "key", "within"])

    return run


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows whose first ``keys`` columns are equal, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[lo] for c in cols)
            if held and key != current:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def roots(near: np.ndarray) -> np.ndarray:
    """Each row's smallest connected row, for a symmetric matrix of booleans."""
    n = len(near)
    label = np.arange(n, dtype=np.int32)
    while True:
        low = label.copy()
        for i in range(0, n, 256):
            low[i : i + 256] = np.minimum(label[i : i + 256], np.where(near[i : i + 256], label[None], n).min(axis=1))
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _bucket_edges(least: int) -> Callable:
    """Rows ``key, node, short`` sorted by key to a tree of edges ``a, b`` for each set of documents that agree in ``least`` tokens."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 1):
            nodes = group.column("node").to_numpy()
            if len(nodes) < 2:
                continue
            order = np.argsort(nodes, kind="stable")
            nodes = nodes[order]
            tokens = np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint8).reshape(-1, TOKENS)[order].T.copy()
            agree = np.zeros((len(nodes), len(nodes)), np.uint8)
            for token in tokens:
                agree += token[:, None] == token[None]
            root = roots(agree >= least)
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    return run


def candidates(reps: DataFrame, similarity: float = 0.8, recall: float = 0.999, limit: int = LIMIT, depth: int = 6, dense: float = 0.6, slack: float = 4.0) -> DataFrame:
    """Edges ``a, b`` that connect all documents that meet in a bucket and look similar enough.

    ``reps`` has distinct ``node`` and non-null ``sketch`` and ``short``. In a bucket of at most ``limit`` documents all
    sketches are compared; agreement may lie ``slack`` standard deviations under the threshold, and is never less for
    being told from single bytes. A larger bucket is split again. What can't be split, as a share of at least ``dense``
    of a bucket stays together or it is the last level, is one family: all its documents are connected to its smallest,
    and the exact comparison that follows tells them apart, so none is dropped.

    Runs are as many as ``recall`` takes: the first ones if buckets are split SHALLOW times at most. A pair may be missed
    there because a bucket that it shares was split more often; then both its documents were in that bucket, and all
    documents of such buckets go through the further runs that ``recall`` takes if all are split ``depth`` times.
    """
    least = math.ceil(TOKENS * (similarity - slack * math.sqrt(similarity * (1 - similarity) / TOKENS)))
    first = runs_for(recall, similarity, SHALLOW)
    edges, deep = _search(reps, range(first), similarity, least, limit, depth, dense)
    if deep is not None:
        more = runs_for(recall, similarity, depth)
        again, _ = _search(reps.join(written(sized(deep.distinct(), reps.count()), "deep"), "node"), range(first, max(more, first + 1)), similarity, least, limit, depth, dense)
        edges = edges.unionByName(again)
    return edges


def _search(reps: DataFrame, runs: range, similarity: float, least: int, limit: int, depth: int, dense: float) -> tuple[DataFrame, DataFrame | None]:
    """Edges ``a, b`` of some runs, and the nodes of buckets that were split more than SHALLOW times (None: no such bucket).

    Of buckets with the same members, one is compared or connected; all of those to be split are, as each is another
    chance to meet. Members are the same if number, smallest, sum and exclusive or of hashes are.
    """
    level = reps.select("node", "sketch", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("size"))
    out: DataFrame | None = None
    deep: DataFrame | None = None
    for at in range(1, depth + 1):
        paths = written(level.mapInArrow(_split(runs, similarity), "node long, key long, within long"), "paths")
        same = ["size", "hub", "total", "mix"]
        marks = paths.groupBy("key").agg(
            F.count(F.lit(1)).alias("size"), F.max("within").alias("within"), F.min("node").alias("hub"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("total"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("mix")
        )
        marks = marks.filter("size > 1")
        picked = written(sized(marks.groupBy(*same).agg(F.min("key").alias("key"), F.min("within").alias("within")), paths.count(), 500_000), "picked")
        over = F.col("size") > limit
        family = over & (F.coalesce(F.col("size") >= dense * F.col("within"), F.lit(False)) | F.lit(at == depth))
        small = paths.join(picked.filter(~over).select("key"), "key").join(reps.select("node", "short"), "node").select("key", "node", "short")
        edges = small.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges(least), "a long, b long")
        out = edges if out is None else out.unionByName(edges)
        if not picked.filter(over).limit(1).count():
            break
        stars = paths.join(picked.filter(family).select("key", "hub"), "key").filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        out = out.unionByName(stars)
        if at == depth or not picked.filter(over & ~family).limit(1).count():
            break
        again = marks.filter(over).join(picked.filter(over & ~family).select(*same), same).select("key", "size")
        level = paths.join(again, "key").join(reps.select("node", "sketch"), "node").select("node", "sketch", "key", "size")
        level = written(sized(level, paths.count(), 100_000), "split")
        if at == SHALLOW:
            deep = level.select("node")
    return out, deep


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``node, group, copies, text`` with the text's distinct shingles in its place."""
    for batch in slices(batches, 3, 2 << 20):
        hashes, first, _, _ = hashed(blobs(batch.column(3)))
        found = pa.array([x.tobytes() for x in distinct(hashes, first)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], ["node", "group", "copies", "shingles"])


SIDES = ("lo_band", "lo", "hi_band", "hi")


def _blocks(sets: DataFrame, similarity: float) -> DataFrame:
    """Each set once for every pair of blocks that its block is part of: ``group, lo_band, lo, hi_band, hi, band, block, node, copies, shingles``.

    A small group is one block. A larger one is dealt to bands by the size of its sets, so wide that sets which can be
    similar enough are in the same or in neighbouring bands, and a band's sets to blocks by their hash. Pairs of blocks
    of other bands can't hold a link and aren't made.
    """
    size = F.octet_length("shingles").cast("long")
    n = sets.count()
    large = sets.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).filter((F.col("n") > BLOCK) | (F.col("bytes") > BYTES)).select("group")
    large = written(sized(large, n), "large")
    if not large.limit(1).count():
        zero = F.lit(0)
        return sets.select("group", *[zero.alias(x) for x in (*SIDES, "band", "block")], "node", "copies", "shingles")
    band = F.floor(F.log(size / 8.0) / (1.01 * math.log(1 / similarity))).cast("int")
    counts = sets.join(large, "group").groupBy("group", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    rows = F.least(F.greatest(F.col("n") / 16, F.lit(BLOCK)), F.lit(MOST))
    counts = counts.withColumn("blocks", F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("bytes") / BYTES)).cast("int"))
    bands = written(sized(counts.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands")), n), "bands")  # a few dozen bands at most
    dealt = sets.join(bands, "group", "left").withColumn("band", F.when(F.col("bands").isNull(), 0).otherwise(band))
    blocks = lambda b: F.coalesce(F.col("bands")[b], F.lit(0))
    dealt = dealt.withColumn("block", F.when(F.col("bands").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), blocks(F.col("band")))).cast("int"))
    others = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda lo_band, lo, hi_band, hi: F.struct(lo_band.alias("lo_band"), lo.alias("lo"), hi_band.alias("hi_band"), hi.alias("hi"))
    b, k = F.col("band"), F.col("block")
    pairs = F.when(F.col("bands").isNull(), F.array(pair(b, k, b, k))).otherwise(
        F.concat(
            F.transform(others(blocks(b)), lambda o: pair(b, F.least(k, o), b, F.greatest(k, o))),
            F.transform(others(blocks(b + 1)), lambda o: pair(b, k, b + 1, o)),
            F.transform(others(blocks(b - 1)), lambda o: pair(b - 1, o, b, k)),
        )
    )
    return dealt.withColumn("pair", F.explode(pairs)).select("group", *[F.col(f"pair.{x}") for x in SIDES], "band", "block", "node", "copies", "shingles")


def _exact(numerator: int, denominator: int) -> Callable:
    """Rows of ``_blocks``, sorted by group and pair, to ``node, links, root``: similarity is at least numerator / denominator."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 5):
            nodes, copies, band, block = (rows.column(c).to_numpy() for c in ("node", "copies", "band", "block"))
            if len(nodes) < 2:
                continue
            order = np.argsort(nodes, kind="stable")
            nodes, copies, side = nodes[order], copies[order], (band.astype(np.int64) << 32 | block)[order]
            column = rows.column("shingles").to_pylist()
            sets = [np.frombuffer(column[i], np.uint64) for i in order]
            both = intersections(sets)
            size = np.array([len(x) for x in sets], np.int64)
            within = all(rows.column(lo)[0].as_py() == rows.column(hi)[0].as_py() for lo, hi in (("lo_band", "hi_band"), ("lo", "hi")))
            near = np.empty(both.shape, bool)
            for i in range(0, len(size), 256):
                some = both[i : i + 256].astype(np.int64)
                near[i : i + 256] = denominator * some >= numerator * (size[i : i + 256, None] + size[None] - some)
                if not within:  # pairs within a block are counted where the block meets itself
                    near[i : i + 256] &= side[i : i + 256, None] != side[None]
            np.fill_diagonal(near, False)
            links = np.array([int(copies[x].sum()) for x in near], np.int64)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[roots(near)[some]])], ["node", "links", "root"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted distinct sets; only values that more than one set has take part. Whole numbers, exact to 2**24 (a text of over 80 MB)."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    rank = np.full(len(values), -1)
    rank[shared] = np.arange(len(shared))
    column = rank[inverse]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]
    for lo in range(0, len(shared), 2048):
        a, b = np.searchsorted(column[order], (lo, lo + 2048))
        m = np.zeros((len(sets), min(2048, len(shared) - lo)), np.float32)
        m[owner[order[a:b]], column[order[a:b]] - lo] = 1
        out += m @ m.T
    return out


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (4, 5), recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, copy_id, class_id, n_links, kept`` for every row.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles (a shorter text: all its words
    as one) is at least ``similarity``, a fraction; words are runs of ASCII letters and digits and of other characters,
    A-Z lower-cased. ``n_links`` counts the other documents that a document is linked to, ``class_id`` is the smallest id
    among documents connected by links, ``copy_id`` the smallest id with the same words. A text without words (or null)
    has no links and a class of its own. Ids are of any type that has an order and keep it; rows that repeat one are
    documents of their own. A null id is larger than any other: a class has it only if no document in it has another.
    An empty table gives no rows; other columns are ignored.

    ``kept`` is true for one document of each class: that with the smallest id, of several with that id the one with the
    smallest ``digest`` (MD5 of the text as it is). Rows that repeat both are all marked.

    Copies of the same words are one set in the join, counted by a grouping with map-side combination. Links are found
    with at least the given recall, and those found are exact.
    """
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    lead = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    reps = prints.filter("sketch IS NOT NULL").groupBy("copy_key").agg(F.min(lead).alias("lead"), F.count(F.lit(1)).alias("copies"), F.min("sketch").alias("sketch"), F.min("short").alias("short"))
    n = prints.count()
    reps = written(sized(reps, n, 25_000).withColumn("node", F.monotonically_increasing_id()), "reps")  # numbers are fixed by writing them
    labels = components(candidates(reps, similarity[0] / similarity[1], recall)).select(F.col("node").alias("of"), F.col("label").alias("group"))
    members = written(sized(reps.join(labels, F.col("node") == F.col("of")).select("node", "group", "copies", "lead"), n), "members")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("digest"))
    texts = perhaps(texts, F.col("digest"), members.select("lead.digest")).filter("_may").drop("_may")
    same = texts.digest.eqNullSafe(members["lead.digest"]) & texts.id.eqNullSafe(members["lead.doc_id"])
    sets = texts.hint("merge").join(members, same).select("node", "group", "copies", "text").mapInArrow(_sets, "node long, group long, copies long, shingles binary")
    sets = written(sized(sets.dropDuplicates(["node"]), members.count(), 10_000), "sets")  # rows repeated whole
    pairs = _blocks(sets, similarity[0] / similarity[1])
    found = pairs.repartition("group", *SIDES).sortWithinPartitions("group", *SIDES).mapInArrow(_exact(*similarity), "node long, links long, root long")
    found = written(gathered(found), "links")
    classes = components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("of"), "label")
    links = found.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    known = reps.select("copy_key", "node", "lead", "copies").join(links, F.col("node") == F.col("linked"), "left").join(classes, F.col("node") == F.col("of"), "left")
    known = written(sized(known.select("copy_key", "lead", F.col("copies").alias("n"), "links", F.coalesce("label", "node").alias("label")), n), "known")
    heads = known.groupBy("label").agg(F.min("lead").alias("head"))
    known = written(sized(known.join(heads, "label").select("copy_key", F.col("lead.doc_id").alias("copy"), "n", "links", "head"), n), "copies")
    rows = prints.select("doc_id", "digest", "copy_key", F.col("sketch").isNull().alias("bare"))
    out = (
        rows.hint("merge")
        .join(known, "copy_key", "left")
        .select(
            "doc_id",
            "digest",
            F.when(F.col("bare"), F.col("doc_id")).otherwise(F.col("copy")).alias("copy_id"),
            F.when(F.col("bare"), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
            F.when(F.col("bare"), F.lit(0)).otherwise(F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
            (F.col("bare") | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("digest") == F.col("head.digest")))).alias("kept"),
        )
    )
    return sized(out, n, 25_000)


def keep_one(docs: DataFrame, similarity: tuple[int, int] = (4, 5), recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one document of each class of ``near_duplicates``; decided row by row, not by id. Of rows that repeat id and text one stays. Texts without words all stay, but for such repeats. An empty table gives no rows."""
    decided = written(sized(near_duplicates(docs, similarity, recall, id_col, text_col).select("doc_id", "digest", "kept"), docs.count()), "decided")
    keyed = docs.withColumn("_digest", text_key(F.col(text_col)))
    repeated = decided.filter("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "digest")
    return settled(keyed, decided.filter("NOT kept"), repeated, id_col).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document with its class of near-duplicates and its number of links."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "copy_id", "class_id", "n_links")
