"""Two-level designed experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.stats import ratio


PRODUCTS = [(0, 1, 2), (1, 2, 3), (0, 2, 3), (0, 1, 3)]


def _base(factors: list[str]) -> int:
    """How many factors of a resolution IV design are free."""
    return min(len(factors), 3 if len(factors) == 4 else 4)


def settings(rows: DataFrame, factors: list[str], centres: int = 0, fractional: bool = False) -> DataFrame:
    """The runs of a two-level design for every row, with the values that the row has for each factor: ``<factor>_low`` and ``<factor>_high``, at ``centres`` further runs their middle. Null values stay null; no rows give no runs."""
    free = _base(factors) if fractional else len(factors)
    if fractional and len(factors) > free + len(PRODUCTS):
        raise ValueError("at most eight factors")
    runs = 1 << free
    run, own = F.col("run"), [c for c in rows.columns if c not in {f"{f}_{end}" for f in factors for end in ("low", "high")}]
    signs: list[Column] = [F.when(run.bitwiseAND(1 << i) != 0, 1).otherwise(-1) for i in range(free)]
    for a, b, c in PRODUCTS[: len(factors) - free]:
        signs.append(signs[a] * signs[b] * signs[c])
    value = lambda f, sign: F.when(run >= runs, (F.col(f"{f}_low") + F.col(f"{f}_high")) / 2).when(sign == 1, F.col(f"{f}_high")).otherwise(F.col(f"{f}_low"))
    dealt = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs + centres - 1))))
    return dealt.select(*own, "run", *[value(f, s).alias(f) for f, s in zip(factors, signs, strict=True)])


def full_factorial(spark: SparkSession, factors: list[str], centres: int = 0) -> DataFrame:
    """All runs of two levels (-1, 1) per factor, numbered from 0, then ``centres`` runs at 0."""
    n = 1 << len(factors)
    level = lambda i: F.when(F.col("run") >= n, 0).when(F.col("run").bitwiseAND(1 << i) != 0, 1).otherwise(-1)
    return spark.range(n + centres).select(F.col("id").alias("run")).select("run", *[level(i).alias(f) for i, f in enumerate(factors)])


def fractional_factorial(spark: SparkSession, factors: list[str]) -> DataFrame:
    """A resolution IV design for up to eight factors: full up to four; beyond, eight or sixteen runs in which each further factor is the product of three of the first."""
    base = _base(factors)
    products = PRODUCTS[:1] if base == 3 else PRODUCTS
    if len(factors) > base + len(products):
        raise ValueError("at most eight factors")
    runs = full_factorial(spark, factors[:base])
    for name, parts in zip(factors[base:], products, strict=False):
        value: Column = F.lit(1)
        for i in parts:
            value = value * F.col(factors[i])
        runs = runs.withColumn(name, value)
    return runs


def effects(runs: DataFrame, factors: list[str], score: str) -> DataFrame:
    """Per factor: mean score at its high level less that at its low one, over the pooled standard error (or as it is, where neither level has spread), and the better level. Ranked by both."""
    long = runs.unpivot([score], factors, "factor", "level")
    at = lambda f, level: f(F.when(F.col("level") == level, F.col(score)))
    per = long.groupBy("factor").agg(at(F.avg, 1).alias("hi"), at(F.avg, -1).alias("lo"), at(F.var_samp, 1).alias("vh"), at(F.var_samp, -1).alias("vl"), at(F.count, 1).alias("nh"), at(F.count, -1).alias("nl"))
    effect = F.coalesce("hi", F.lit(0.0)) - F.coalesce("lo", F.lit(0.0))
    variance = (F.coalesce("vh", F.lit(0.0)) + F.coalesce("vl", F.lit(0.0))) / 2
    error = F.sqrt(variance / F.greatest(F.lit(1), F.least("nh", "nl")))
    rows = per.select("factor", F.round(effect, 9).alias("effect"), F.round(F.when(error > 0, ratio(effect, error)).otherwise(effect), 9).alias("t"))
    better = F.when(F.col("effect") > 1e-9, "high").when(F.col("effect") < -1e-9, "low").otherwise("none")
    return rows.withColumn("better", better)
