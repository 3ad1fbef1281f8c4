"""Three-way reconciliation of keyed snapshots, and unions of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aligned(base: DataFrame, current: DataFrame, replayed: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per key of any snapshot: ``b, c, r``, each a struct of ``cols`` or null."""
    side = lambda df, name: df.select(F.col(key), F.struct(*cols).alias(name))
    return side(base, "b").join(side(current, "c"), key, "full").join(side(replayed, "r"), key, "full")


def label() -> Column:
    """What became of an aligned row."""
    b, c, r = F.col("b"), F.col("c"), F.col("r")
    same = c.eqNullSafe(r)
    return (
        F.when(b.isNull() & c.isNotNull() & r.isNotNull(), F.when(same, "added_both").otherwise("conflict_added"))
        .when(b.isNull(), F.when(c.isNotNull(), "added_current").otherwise("added_replayed"))
        .when(same, F.when(c.eqNullSafe(b), "unchanged").when(c.isNull(), "deleted_both").otherwise("changed_both"))
        .when(c.eqNullSafe(b), F.when(r.isNull(), "deleted_replayed").otherwise("changed_replayed"))
        .when(r.eqNullSafe(b), F.when(c.isNull(), "deleted_current").otherwise("changed_current"))
        .otherwise(F.when(c.isNull() | r.isNull(), "conflict_deleted").otherwise("conflict_changed"))
    )


def rows(aligned_rows: DataFrame, key: str) -> DataFrame:
    """Row-wise merge: what both did, or the one that changed; conflicting rows have ``conflict`` set and no value."""
    b, c, r = F.col("b"), F.col("c"), F.col("r")
    merged = F.when(c.eqNullSafe(r), c).when(c.eqNullSafe(b), r).when(r.eqNullSafe(b), c)
    clean = c.eqNullSafe(r) | c.eqNullSafe(b) | r.eqNullSafe(b)
    return aligned_rows.select(key, label().alias("label"), merged.alias("merged"), (~clean).alias("conflict")).filter(F.col("merged").isNotNull() | F.col("conflict"))


def fields(aligned_rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Field-wise merge of rows that all three have: each field as its row merge would be, and ``conflicts``, the fields that both changed differently."""
    out, bad = [], []
    for c in cols:
        b, x, y = (F.col(f"{s}.{c}") for s in "bcr")
        out.append(F.when(x.eqNullSafe(y) | y.eqNullSafe(b), x).when(x.eqNullSafe(b), y).alias(c))
        bad.append(F.when(~(x.eqNullSafe(y) | x.eqNullSafe(b) | y.eqNullSafe(b)), F.lit(c)))
    both = aligned_rows.filter("b IS NOT NULL AND c IS NOT NULL AND r IS NOT NULL")
    return both.select(key, *out, F.array_compact(F.array(*bad)).alias("conflicts"))


def tail(base: Column, side: Column) -> Column:
    """What a side appended to the base list; null if it edited the base's items."""
    n = F.size(base)
    return F.when(F.slice(side, 1, F.greatest(n, F.lit(1))).eqNullSafe(base) | (n == 0), F.slice(side, n + 1, F.greatest(F.size(side) - n, F.lit(0))))


def list_union(base: Column, current: Column, replayed: Column) -> Column:
    """Base, the current side's appended items, then the replayed side's; null if a side edited the base's items, both appended a common item or nothing was appended."""
    x, y = tail(base, current), tail(base, replayed)
    fine = x.isNotNull() & y.isNotNull() & ~F.arrays_overlap(x, y) & (F.size(x) + F.size(y) > 0)
    return F.when(fine, F.concat(base, x, y))


def map_union(base: Column, current: Column, replayed: Column) -> Column:
    """Union of the entries that both sides added to a map; null if a side changed or dropped an entry, or both added a key."""
    new = lambda side: F.map_filter(side, lambda k, _: ~F.array_contains(F.map_keys(base), k))
    intact = lambda side: F.forall(F.map_entries(base), lambda e: side[e["key"]].eqNullSafe(e["value"]))
    x, y = new(current), new(replayed)
    fine = intact(current) & intact(replayed) & ~F.arrays_overlap(F.map_keys(x), F.map_keys(y))
    return F.when(fine, F.map_concat(base, x, y))


def first_rule(**rules: Column) -> Column:
    """The first rule, in the order given, that has a result: struct of ``rule`` and ``value``."""
    out: Column | None = None
    for name, value in rules.items():
        made = F.struct(F.lit(name).alias("rule"), value.alias("value"))
        out = F.when(value.isNotNull(), made) if out is None else out.when(value.isNotNull(), made)
    return out
