"""What fits: sections under a budget, schedules, proportional shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fitted(sections: DataFrame, keys: list[str], priority: str, size: str, budget: int, cut: str | None = None) -> DataFrame:
    """Sections kept by priority while their running size fits; one of kind ``cut`` (column ``kind``) that overflows is shortened to what is left instead of dropped. Adds ``used``."""
    before = Window.partitionBy(*keys).orderBy(priority).rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.sum(size).over(before), F.lit(0)))
    used = F.when(F.col(size) <= F.col("_room"), F.col(size)).when((F.col("kind") == cut) & (F.col("_room") > 0), F.col("_room")) if cut else F.when(F.col(size) <= F.col("_room"), F.col(size))
    return sections.withColumn("_room", room).withColumn("used", used).filter("used IS NOT NULL").drop("_room")


def temperature(place: Column, n: Column, high: float, low: float) -> Column:
    """The first half of the samples, rounded up, high, the rest low."""
    return F.when(place <= F.ceil(n / 2), high).otherwise(low)


def prefix_sizes(total: Column, epoch: Column, epochs: int) -> Column:
    """How many cases an epoch looks at: a share that grows evenly to all in the last, at least one."""
    return F.greatest(F.lit(1), F.ceil(total * epoch / epochs)).cast("long")


def shares(rows: DataFrame, keys: list[str], order: str, weight: str, start: Column, length: Column) -> DataFrame:
    """Contiguous spans ``lo, hi`` (half open) of a range, in proportion to the rows' weights and in their order, without gaps."""
    upto = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    edge = lambda s: (start + F.round(length * s / F.sum(weight).over(whole))).cast("long")
    return rows.withColumns({"lo": edge(F.sum(weight).over(upto) - F.col(weight)), "hi": edge(F.sum(weight).over(upto))})


def first_per_code(errors: DataFrame, keys: list[str], code: str, pos: str, most: int) -> DataFrame:
    """The first error of each code, coded ones before those without a code, at most ``most`` per key: the root causes to report."""
    w = Window.partitionBy(*keys, F.coalesce(F.col(code), F.col(pos).cast("string"))).orderBy(pos)
    firsts = errors.withColumn("_i", F.row_number().over(w)).filter("_i = 1")
    order = Window.partitionBy(*keys).orderBy(F.col(code).isNull(), pos)
    return firsts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("_i")


def quality(levels: dict[str, tuple[Column, float]], scale: dict[str, float]) -> Column:
    """Weighted mean of named levels (such as high, medium, low), each a number by ``scale``; an unknown level counts 0; kept within 0..1."""
    table = F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])
    total: Column = F.lit(0.0)
    for value, weight in levels.values():
        total = total + weight * F.coalesce(table[value], F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
