"""Quality of mechanisms, settings and runs, from labelled outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.stats import ratio


def by_mechanism(outcomes: DataFrame, known: list[str], mechanism: str, outcome: str, probed: str, applies: str, tested: str) -> DataFrame:
    """Per mechanism: accepted, escalated, accepted but failed a later probe or test, and the rate of acceptance.

    A missing probe or test is no failure. Mechanisms that aren't ``known`` count accepted and escalated only; rows with
    an empty or null one are under the empty name and only counted.
    """
    name = F.coalesce(F.col(mechanism), F.lit(""))
    listed, legacy = name.isin(known), name == ""
    ok = F.col(outcome) == "accepted"
    out = outcomes.groupBy(name.alias("mechanism")).agg(
        F.count_if(ok & ~legacy).alias("accepted"),
        F.count_if((F.col(outcome) == "escalated") & ~legacy).alias("escalated"),
        F.count_if(ok & listed & F.col(probed).eqNullSafe(True) & F.col(applies).eqNullSafe(False)).alias("later_probe_failures"),
        F.count_if(ok & listed & F.col(tested).eqNullSafe(False)).alias("later_test_failures"),
        F.count_if(legacy).alias("legacy"),
    )
    return out.withColumn("accept_rate", ratio(F.col("accepted"), F.col("accepted") + F.col("escalated")))


def replicated(runs: DataFrame, setting: str, case: str, correct: Column, proxy: str, latency: str) -> DataFrame:
    """Per setting, over cases that were run several times: cases that most runs got right, mean latency, and the shares that one run or all runs got right.

    A majority is more than half; a failed run (null latency) counts as 0.0 there.
    """
    per = runs.groupBy(setting, case).agg(F.count(F.lit(1)).alias("reps"), F.count_if(correct).alias("good"), F.sum(proxy).alias("proxy"), F.avg(F.coalesce(F.col(latency), F.lit(0.0))).alias("latency"))
    return per.groupBy(setting).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(F.col("good") * 2 > F.col("reps")).alias("n_correct"),
        F.avg(F.col("good") / F.col("reps")).alias("agreement"),
        F.avg(F.when(F.col("good") >= 1, 1.0).otherwise(0.0)).alias("pass_at_k"),
        F.avg(F.when(F.col("good") == F.col("reps"), 1.0).otherwise(0.0)).alias("pass_all_k"),
        F.sum(F.col("proxy") / F.col("reps")).alias("proxy_sum"),
        F.avg("latency").alias("mean_latency"),
    )


def proxy(syntax: Column, preserved: Column, scope: Column, one_side: Column, new_errors: Column) -> Column:
    """A coarse score: one up for each sound sign, down for a copied side and for each new error; missing signs count nothing."""
    one = lambda c: F.when(c.eqNullSafe(True), 1.0).otherwise(0.0)
    return one(syntax) + one(preserved) + one(scope) - one(one_side) - F.coalesce(F.greatest(new_errors.cast("double"), F.lit(0.0)), F.lit(0.0))


def best_settings(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best settings: more correct, then larger proxy, then smaller latency, then first recorded (``pos``)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n_correct"), F.desc("proxy_sum"), "mean_latency", "pos")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def coverage(rows: DataFrame, keys: list[str], preserved: str, total: str) -> DataFrame:
    """Ratio of sums, not mean of ratios, over rows with a total; null without one."""
    return rows.filter(F.col(total) > 0).groupBy(*keys).agg(F.sum(preserved).alias("preserved"), F.sum(total).alias("total")).withColumn("coverage", F.try_divide("preserved", "total"))


def same_histogram(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """One row: whether every value of ``col`` is as frequent in both, and how many are not."""
    count = lambda df, n: df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias(n))
    both = count(a, "x").join(count(b, "y"), "v", "full").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return both.agg(F.coalesce(F.every(F.col("x") == F.col("y")), F.lit(True)).alias("same"), F.count_if(F.col("x") != F.col("y")).alias("n_different"))
