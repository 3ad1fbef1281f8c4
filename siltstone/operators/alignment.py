"""Alignment of two sequences by a longest common subsequence, the same one whatever else repeats.

Of all longest ones, that is taken which ends in the last element of ``a`` that can end it, at its first possible place in
``b``, and goes on backwards in the same way: the one that patience sorting of all matches finds. Rows of the table of
lengths are bit sets, a few machine words for many places, so elements that repeat often cost no more than others.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = "array<struct<i:int,j:int,n:int>>"


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places, rising in both. None equals None.

    A set bit of a row is a place of ``b`` that adds nothing to the length. Only every so many rows are kept, those
    between are made again on the way back: memory is that of about 2 sqrt(len(a)) rows.
    """
    where: dict[object, int] = {}
    places: dict[object, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    full = (1 << len(b)) - 1
    for x in set(a) & places.keys():
        bits = bytearray(len(b) // 8 + 1)
        for j in places[x]:
            bits[j >> 3] |= 1 << (j & 7)
        where[x] = int.from_bytes(bits, "little")
    useful = [i for i, x in enumerate(a) if x in where]  # other elements leave a row as it was
    step = isqrt(len(useful)) + 1

    def after(row: int, x: object) -> int:
        common = row & where[x]
        return ((row + common) | (row & ~where[x])) & full

    kept, row = [full], full
    for n, i in enumerate(useful, 1):
        row = after(row, a[i])
        if n % step == 0:
            kept.append(row)
    length = len(b) - row.bit_count()
    out: list[tuple[int, int]] = []
    for block in reversed(range(-(-len(useful) // step))):
        if not length:
            break
        some = useful[block * step : (block + 1) * step]
        rows = [kept[block]]
        for i in some[:-1]:
            rows.append(after(rows[-1], a[i]))
        for i, row in zip(reversed(some), reversed(rows), strict=True):
            if not length:
                break
            js = places[a[i]]
            before = lambda j: j - (row & ((1 << j) - 1)).bit_count()  # noqa: B023, E731 - length of what ends before j
            at = bisect_right(js, length - 2, key=before)  # the first place with as much before it as is still wanted
            if at < len(js) and before(js[at]) == length - 1:
                out.append((i, js[at]))
                length -= 1
    out.reverse()
    return out


def _blocks(pairs: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for i, j in pairs:
        if out and out[-1]["i"] + out[-1]["n"] == i and out[-1]["j"] + out[-1]["n"] == j:
            out[-1]["n"] += 1
        else:
            out.append({"i": i, "j": j, "n": 1})
    return out


def aligned(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with ``blocks``: the matching runs of the arrays ``a`` and ``b``, each the place in both and the length. A null array counts as empty; null elements equal each other. Pairs are aligned where they are, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_blocks(matched(x or [], y or [])) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "blocks"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("blocks", T.DataType.fromDDL(BLOCKS))]))


def shared(blocks: Column) -> Column:
    """How many elements match."""
    return F.aggregate(blocks, F.lit(0), lambda s, x: s + x["n"])


def likeness(blocks: Column, n_a: Column, n_b: Column) -> Column:
    """Twice the matches by the elements of both; 1 where both are empty."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise(2.0 * shared(blocks) / (n_a + n_b))


def opcodes(blocks: Column, n_a: Column, n_b: Column) -> Column:
    """Runs ``tag, i1, i2, j1, j2`` that cover both sequences: ``equal`` ones, and between them ``replace``, ``delete`` or ``insert``."""
    stop = F.struct(n_a.cast("int").alias("i"), n_b.cast("int").alias("j"), F.lit(0).alias("n"))
    all_ = F.concat(blocks, F.array(stop))
    op = lambda tag, i1, i2, j1, j2: F.struct(tag.alias("tag"), i1.alias("i1"), i2.alias("i2"), j1.alias("j1"), j2.alias("j2"))

    def around(x: Column, k: Column) -> Column:
        last = F.when(k > 0, F.get(all_, k - 1))
        i, j = F.coalesce(last["i"] + last["n"], F.lit(0)), F.coalesce(last["j"] + last["n"], F.lit(0))
        tag = F.when((i < x["i"]) & (j < x["j"]), "replace").when(i < x["i"], "delete").when(j < x["j"], "insert")
        return F.array(op(tag, i, x["i"], j, x["j"]), op(F.when(x["n"] > 0, "equal"), x["i"], x["i"] + x["n"], x["j"], x["j"] + x["n"]))

    return F.filter(F.flatten(F.transform(all_, around)), lambda x: x["tag"].isNotNull())
