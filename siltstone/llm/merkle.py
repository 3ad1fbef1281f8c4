"""A Merkle manifest of a dataset: a tree over the rows of each group, a tree over the groups' roots, and proofs of rows.

Nodes are combined as they come: a task keeps the parents that lack children, a parent with all of its children (how many
follows from the group's size) is emitted and is at once a child of its own parent. What still waits at a task's end is
dealt anew, by ever wider spans of leaves, until nothing waits. Each emitted parent keeps its children's digests: these
reverse links are followed from the root down, some levels at a time, and give every row its siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import table, written
from siltstone.functions.stats import dealt

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that are followed down in one step; a task of it holds fanout ** BAND nodes at most for each node it starts from.
BAND = 12
#: How many times wider the spans are in which waiting nodes meet, each time they are dealt anew.
WIDER = 1024


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """SHA-256 of a row's fields, as binary."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def node_digest(kids: list[bytes]) -> bytes:
    """SHA-256 of the children's digests in hex."""
    return hashlib.sha256(b"".join(kids).hex().encode()).digest()


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``place`` in the group (from 0) and the group's ``size``. Null groups are a group, null orders come first.

    No group is one task's: rows are dealt by ranges, numbered in each range, and count on from the ranges before it.
    """
    parts = dealt(rows, [group], order)
    counts = parts.groupBy(F.col(group).alias("_of"), "_range").agg(F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy("_of")
    base = counts.select("_of", "_range", (F.sum("_n").over(of.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(of).alias("size"))
    own = parts.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)))
    joined = own.join(base, (own["_range"] == base["_range"]) & own[group].eqNullSafe(base["_of"]))
    return joined.select(*[own[c] for c in rows.columns], (F.col("_i") - 1 + F.col("_before")).alias("place"), "size")


def _width(size: int, level: int, fanout: int) -> int:
    """How many nodes a tree of ``size`` leaves has at a level."""
    return -(-size // fanout**level)


def height(size: int, fanout: int) -> int:
    level = 0
    while _width(size, level, fanout) > 1:
        level += 1
    return level


_NODES = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("kids", pa.list_(pa.binary())), ("state", pa.string())])
_NODES_DDL = "tree string, level int, idx long, size long, digest binary, kids array<binary>, state string"


def _combine(fanout: int):
    """Takes nodes in any order and emits parents whose children are all there (``made``), roots (``root``) and nodes whose parent lacks others (``waits``). Nodes that come in order keep few parents open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple, dict[int, bytes]] = {}
        sizes: dict[str | None, int] = {}
        for batch in batches:
            out = []
            for tree, level, idx, size, digest in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                sizes[tree] = size
                while _width(size, level, fanout) > 1:
                    parent = idx // fanout
                    arity = min(fanout, _width(size, level, fanout) - parent * fanout)
                    have = partial.setdefault((tree, level + 1, parent), {})
                    have[idx] = digest
                    if len(have) < arity:
                        break
                    del partial[tree, level + 1, parent]
                    kids = [have[i] for i in sorted(have)]
                    level, idx, digest = level + 1, parent, node_digest(kids)
                    out.append((tree, level, idx, size, digest, kids, "made"))
                else:
                    out.append((tree, level, idx, size, digest, None, "root"))
            if out:
                yield _batch(out)
        left = [(tree, level - 1, i, sizes[tree], d, None, "waits") for (tree, level, _), have in partial.items() for i, d in have.items()]
        for at in range(0, len(left), 10_000):
            yield _batch(left[at : at + 10_000])

    return run


def _batch(rows: list[tuple], schema: pa.Schema = _NODES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Trees:
    """``leaves``: ``tree, place, size, digest`` and what came with them; ``links``: ``tree, level, idx, size, digest, kids``; ``roots``: ``tree, size, digest``."""

    leaves: DataFrame
    links: DataFrame
    roots: DataFrame
    fanout: int


def build(rows: DataFrame, tree: str, order: list[str], fanout: int = 2) -> Trees:
    """A tree for each value of ``tree`` over its rows' ``digest`` in the given order; ``fanout`` consecutive nodes, the last of a level fewer, make a parent. One row is its own root. Rows that are equal in all of ``order`` and in their digest are leaves of their own. No rows give no trees.

    A task's waiting nodes are at most two for each level and group that it holds an end of; they are dealt anew by spans
    of leaves, each time ``WIDER`` times as wide, until a span is a whole group.
    """
    leaves = written(numbered(rows.withColumnRenamed(tree, "tree") if tree != "tree" else rows, "tree", [*order, "digest"]), "leaves")
    spark = rows.sparkSession
    each = max(1, leaves.count() // int(spark.conf.get("spark.sql.shuffle.partitions")))
    levels = height(each, fanout) + height(WIDER, fanout)
    nodes = leaves.select("tree", F.lit(0).alias("level"), F.col("place").alias("idx"), "size", "digest")
    links = roots = None
    while True:
        out = written(nodes.mapInArrow(_combine(fanout), _NODES_DDL), "nodes")
        made, top = out.filter("state = 'made'").drop("state"), out.filter("state = 'root'").select("tree", "size", "digest")
        links, roots = (made, top) if links is None else (links.unionByName(made), roots.unionByName(top))
        waiting = out.filter("state = 'waits'")
        if not waiting.limit(1).count():
            return Trees(leaves, links, roots, fanout)
        first = F.col("idx") * F.pow(F.lit(fanout).cast("double"), F.col("level")).cast("long")
        span = F.floor(first / F.lit(float(fanout) ** min(levels, 62))).alias("span")
        nodes = waiting.select("tree", "level", "idx", "size", "digest", span, first.alias("first")).repartition("tree", "span").sortWithinPartitions("tree", "first", "level").select("tree", "level", "idx", "size", "digest")
        levels += height(WIDER, fanout)


_DOWN = "kind int, tree string, top long, level int, idx long, size long, kids array<binary>, path array<binary>, subroot binary, leaf binary, claim binary, id long"


def _follow(fanout: int, floor: int, full: bool):
    """From paths of nodes down over the links below them: to paths of the nodes at level ``floor``, or, for leaves, to what their rows need."""

    def step(kids: list[bytes], j: int) -> bytes:
        return bytes([j]) + b"".join(kids[:j] + kids[j + 1 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, paths, subroot = None, {}, b""
        for batch in batches:
            out = []
            for kind, tree, top, level, idx, size, kids, path, root, leaf, claim, key in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (tree, top) != block:
                    block, paths = (tree, top), {}
                if kind == 0:
                    chain = None
                    for s in reversed(path):
                        chain = (s, chain)
                    paths[level, idx], subroot = chain, root
                elif kind == 1:
                    above = paths.pop((level, idx))
                    for j in range(len(kids)):
                        node = idx * fanout + j
                        chain = (step(kids, j), above)
                        if level - 1 == floor and floor:
                            out.append((tree, floor, node, size, _list(chain), subroot))
                        else:
                            paths[level - 1, node] = chain
                else:
                    chain = paths.pop((0, idx))
                    out.append((tree, idx, key, leaf, subroot, *_proof(chain, claim if claim is not None else leaf), _list(chain) if full else None))
            if out:
                yield _batch(out, _PATHS if floor else _PROOFS)

    return run


_PATHS = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("size", pa.int64()), ("path", pa.list_(pa.binary())), ("subroot", pa.binary())])
_PROOFS = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("id", pa.int64()), ("leaf", pa.binary()), ("subroot", pa.binary()), ("proof", pa.binary()), ("folded", pa.binary()), ("path", pa.list_(pa.binary()))])


def _list(chain: tuple | None) -> list[bytes]:
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return out


def _proof(chain: tuple | None, digest: bytes) -> tuple[bytes, bytes]:
    """The digest of all siblings from the leaf upwards, and the root that ``digest`` gives with them. A step is the number of siblings on the left, and the siblings."""
    siblings = hashlib.sha256()
    while chain is not None:
        s, chain = chain
        siblings.update(s[1:].hex().encode())
        left = 1 + 32 * s[0]
        digest = hashlib.sha256((s[1:left] + digest + s[left:]).hex().encode()).digest()
    return siblings.digest(), digest


def proofs(trees: Trees, tops: DataFrame, full: bool = False) -> DataFrame:
    """``tree, place, id, leaf, subroot, proof, folded, path`` for every leaf.

    ``tops`` has each tree's ``tree, size, path, subroot``: the steps above its root and the root's digest. ``proof`` is
    SHA-256 of all siblings in hex, ``folded`` the root that the leaf's ``claim`` gives (its digest where that is null),
    ``path`` the steps themselves where ``full``. Links are followed ``BAND`` levels at a time, each node at the upper end
    of a band with what is below it in one group.
    """
    fan, leaves = trees.fanout, trees.leaves
    most = trees.roots.agg(F.max("size").alias("n")).first()["n"] or 1
    level_of = F.lit(0)
    for h in range(1, height(most, fan) + 1):
        level_of = F.when(F.col("size") > fan ** (h - 1), F.lit(h)).otherwise(level_of)
    paths = tops.select("tree", level_of.cast("int").alias("level"), F.lit(0).cast("long").alias("idx"), "size", "path", "subroot")
    blank = {"kids": "array<binary>", "path": "array<binary>", "subroot": "binary", "leaf": "binary", "claim": "binary", "id": "long"}
    names = [x.split()[0] for x in _DOWN.split(", ")]

    def shaped(df: DataFrame, kind: int, top: Column) -> DataFrame:
        return df.withColumns({"kind": F.lit(kind), "top": top} | {c: F.lit(None).cast(t) for c, t in blank.items() if c not in df.columns}).select(names)

    for band in reversed(range(max(1, -(-height(most, fan) // BAND)))):
        floor, ceiling = band * BAND, (band + 1) * BAND
        at = F.floor(F.col("idx") / F.pow(F.lit(float(fan)), F.lit(ceiling) - F.col("level"))).cast("long")
        here = F.col("level") > floor if band else F.lit(True)
        rows = shaped(paths.filter(here & (F.col("level") <= ceiling)), 0, at)
        rows = rows.unionByName(shaped(trees.links.filter((F.col("level") > floor) & (F.col("level") <= ceiling)).drop("digest"), 1, at))
        if not band:
            own = leaves.select("tree", F.lit(0).alias("level"), F.col("place").alias("idx"), "size", F.col("digest").alias("leaf"), "claim", "id")
            rows = rows.unionByName(shaped(own, 2, at))
        rows = rows.repartition("tree", "top").sortWithinPartitions("tree", "top", "kind", F.desc("level"), "idx")
        if not band:
            return rows.mapInArrow(_follow(fan, 0, full), "tree string, place long, id long, leaf binary, subroot binary, proof binary, folded binary, path array<binary>")
        below = written(rows.mapInArrow(_follow(fan, floor, full), "tree string, level int, idx long, size long, path array<binary>, subroot binary"), "paths")
        paths = paths.filter(F.col("level") <= floor).unionByName(below)
    raise AssertionError


def manifest(rows: DataFrame, group: str = "lang", order: str = "id", fanout: int = 2) -> tuple[DataFrame, str | None]:
    """Proofs of all rows, and the root over all groups, in hex (None without rows).

    ``rows`` has whole-number ids ``id``, ``digest`` (of the row), ``claim`` (the digest that is asserted for it, or null)
    and the group, a string. Groups are leaves of a tree of their own, by name, null first. A repeated id is a leaf for
    each of its rows, by digest; a null id comes first.
    """
    trees = build(rows, group, [order], fanout)
    none = F.lit(None)
    groups = trees.roots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest", none.cast("binary").alias("claim"), none.cast("long").alias("id"), F.col("size").alias("rows"))
    upper = build(groups, "all", ["name"], fanout)
    top = upper.roots.first()
    if top is None:
        empty = rows.sparkSession.createDataFrame([], "tree string, place long, id long, leaf binary, subroot binary, proof binary, folded binary, path array<binary>")
        return empty, None
    start = upper.roots.select("tree", "size", F.array().cast("array<binary>").alias("path"), F.col("digest").alias("subroot"))
    over = proofs(upper, start, full=True).select("place", "path")
    tops = written(upper.leaves.join(over, "place").select(F.col("name").alias("tree"), F.col("rows").alias("size"), "path", F.col("digest").alias("subroot")), "tops")
    return proofs(trees, tops), bytes(top["digest"]).hex()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's leaf, its language's root, the root, its proof, and what a tampered row folds to.

    Null fields are hashed as such, a null language is a group of its own, a row without an id isn't tampered with. Rows
    that repeat an id, or all of a row, are leaves of their own. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    values = {c: F.col(c) for c in COLUMNS}
    narrow = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("id"), row_digest(*values.values()).alias("digest"), F.when(chosen, row_digest(*(values | {"n_chars": more}).values())).alias("claim"))
    found, root = manifest(written(narrow, "rows"))
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(root).cast("string")
    return found.select(F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == root).alias("verified"))


ORACLE = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
    coalesce(strlen(text) || ':' || text, '-') AS after
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(before || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || after) END AS claim
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, place AS idx, size AS width, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, any_value(level) + 1, idx // 2, (any_value(width) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE width > 1 GROUP BY lang, idx // 2),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE width = 1),
uppers AS (
  SELECT 0 AS level, place AS idx, size AS width, subroot AS digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, idx // 2, (any_value(width) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM uppers WHERE width > 1 GROUP BY idx // 2),
steps AS (
  SELECT p.lang, p.place, a.level, a.idx % 2 AS odd, coalesce(s.digest, '') AS sibling
  FROM placed p JOIN nodes a ON a.lang IS NOT DISTINCT FROM p.lang AND a.idx = p.place >> a.level AND a.width > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM a.lang AND s.level = a.level AND s.idx = xor(a.idx, 1)
  UNION ALL
  SELECT p.lang, p.place, 1000 + a.level, a.idx % 2, coalesce(s.digest, '')
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN uppers a ON a.idx = r.place >> a.level AND a.width > 1
  LEFT JOIN uppers s ON s.level = a.level AND s.idx = xor(a.idx, 1)),
proofs AS (
  SELECT lang, place, string_agg(sibling, '' ORDER BY level) AS siblings, list({'odd': odd, 'digest': sibling} ORDER BY level) AS path FROM steps GROUP BY lang, place),
folded AS (
  SELECT p.doc_id, p.leaf, r.subroot, (SELECT digest FROM uppers WHERE width = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend({'odd': 0::BIGINT, 'digest': coalesce(claim, leaf)}, coalesce(path, [])),
      lambda x, s: {'odd': 0::BIGINT, 'digest': sha256(CASE WHEN s.odd = 1 THEN s.digest || x.digest ELSE x.digest || s.digest END)}).digest AS folded_root
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.place = p.place)
SELECT *, folded_root = root AS verified FROM folded
"""
