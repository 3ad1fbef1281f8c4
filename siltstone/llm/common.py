"""Helpers that the operators of this subpackage share: tables, the shared scratch folder, written intermediates."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.scratch import gathered, scratch, shared_dir, sized, written

__all__ = ["FOLD", "LOWER", "UPPER", "Characters", "ascii_lower", "blobs", "gathered", "kept", "lean", "perhaps", "scratch", "shared_dir", "sized", "slices", "splitmix", "table", "written"]

#: A-Z and a-z, for lower-casing of ASCII letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes to bytes: A-Z to a-z, separators to a space; digits, letters and all bytes of other characters as they are.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """``c`` with A-Z lower-cased and every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes each; a longer single value is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = batch.column(column).cast(pa.large_binary())
        length = pa.compute.binary_length(size).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(length):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def blobs(column: pa.Array) -> list[bytes]:
    """The strings of a column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def perhaps(rows: DataFrame, key: Column, wanted: DataFrame, bits: int = 26) -> DataFrame:
    """``rows`` with ``_may``: whether ``key`` may be a ``digest`` of ``wanted``, so that few others are shuffled to meet it. A null key may not.

    A bit for each hash of a wanted digest, in at most 2**bits bits (8 MB, however many there are: all that is broadcast).
    With very many all bits are set, and all rows pass.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    maps = wanted.select(slot(F.col("digest")).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_map"))
    at = F.bitmap_bit_position(slot(key))
    byte = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(written(sized(maps, 1), "bits")), F.bitmap_bucket_number(slot(key)) == F.col("_bucket"), "left")
    may = F.coalesce(key.isNotNull() & (F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1), F.lit(False))
    return met.select(*rows.columns, may.alias("_may"))


_kept: dict[Hashable, object] = {}
_used: set[Hashable] = set()


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """A worker's one model, made by the first task that asks for ``key``. Another key, or a ``lean`` task that asks for none, takes its place, so a worker that serves many operators holds no more than the one at work needs."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    _used.add(key)
    return _kept[key]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving what it has freed back to the machine when its task ends: workers are used again, and wait with what they hold."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _used.clear()
        try:
            yield from run(batches)
        finally:
            _release()

    return whole


def _release() -> None:
    if not _used:
        _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Characters:
    """Which characters a library treats as our own pattern does, learned as they come; ASCII is taken to be alike.

    ``alike`` says of a string of characters whether all of them are treated alike; it is asked about 64 at a time, and
    halves of those if they aren't. What ``never`` finds isn't, without asking.
    """

    def __init__(self, alike: Callable[[str], bool], never: regex.Pattern | None = None):
        self.alike, self.never = alike, never
        self.kind = np.zeros(0x110000, np.uint8)  # 0 not met, 1 alike, 2 not
        self.kind[:128] = 1

    def all_alike(self, text: str) -> bool:
        if text.isascii():
            return True
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kind[codes]
        new = np.unique(codes[kinds == 0])
        if len(new):
            self._learn("".join(map(chr, new.tolist())))
            kinds = self.kind[codes]
        return not (kinds == 2).any()

    def _learn(self, new: str) -> None:
        if self.never is not None:
            self.kind[[ord(c) for c in self.never.findall(new)]] = 2
            new = self.never.sub("", new)
        waiting = [new[i : i + 64] for i in range(0, len(new), 64)]
        while waiting:
            some = waiting.pop()
            fine = self.alike(some)
            if fine or len(some) == 1:
                self.kind[[ord(c) for c in some]] = 1 if fine else 2
            else:
                waiting += [some[: len(some) // 2], some[len(some) // 2 :]]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: mixes all bits of each value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
