"""Clusters of equal samples, votes, entropy and agreement on facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.stats import running


def clusters(samples: DataFrame, keys: list[str], text: Column, pos: str) -> DataFrame:
    """Per group and normal form: ``norm, size, first`` (the member that came first) and ``place`` by size, then first seen."""
    rows = samples.select(*keys, F.md5(text).alias("norm"), F.col(pos).alias("pos"))
    found = rows.groupBy(*keys, "norm").agg(F.count(F.lit(1)).alias("size"), F.min("pos").alias("first"))
    return running(found.withColumn("_less", -F.col("size")), keys, ["_less", "first"], {"place": F.lit(1)}).drop("_less", "place_all")


def entropy(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: ``n, n_clusters, agreement`` (share of the largest cluster) and ``entropy`` of the cluster sizes, 1 if all samples differ; 0 for a single sample."""
    total = found.groupBy(*keys).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("n_clusters"), F.max("size").alias("top"), F.sum(F.col("size") * F.log2("size")).alias("slogs"))
    h = F.log2("n") - F.col("slogs") / F.col("n")
    return total.select(*keys, "n", "n_clusters", (F.col("top") / F.col("n")).alias("agreement"), F.when(F.col("n") > 1, F.greatest(F.lit(0.0), h / F.log2("n"))).otherwise(F.lit(0.0)).alias("entropy"))


def winners(samples: DataFrame, keys: list[str], text: Column, pos: str, consistency: Column, confidence: Column, length: Column) -> DataFrame:
    """The winning sample of each group: largest cluster, then its first member's consistency, confidence and brevity, then first seen."""
    found = clusters(samples, keys, text, pos).drop("place")
    facts = samples.select(*keys, F.col(pos).alias("first"), consistency.alias("consistency"), confidence.alias("confidence"), length.alias("length"))
    ranked = found.join(facts, [*keys, "first"])
    w = Window.partitionBy(*keys).orderBy(F.desc("size"), F.desc("consistency"), F.desc("confidence"), "length", "first")
    return ranked.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def fact_shares(facts: DataFrame, group: str, member: str, key: str, value: str) -> DataFrame:
    """Per fact of each member: ``share`` of members of the group that state the same value for the key."""
    counts = facts.groupBy(group, key, value).agg(F.count(F.lit(1)).alias("same"))
    whole = Window.partitionBy(group, key)
    shares = counts.select(group, key, value, (F.col("same") / F.sum("same").over(whole)).alias("share"))
    return facts.select(group, member, key, value).join(shares, [group, key, value])


def consistency(facts: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Per group: ``aggregate`` mean share of each key's most frequent value, and ``n_low`` keys on which at least a third disagree."""
    counts = facts.groupBy(group, key, value).agg(F.count(F.lit(1)).alias("same"))
    per = counts.groupBy(group, key).agg(F.max("same").alias("top"), F.sum("same").alias("n"), F.count(F.lit(1)).alias("values"))
    low = (F.col("values") > 1) & ((F.col("n") - F.col("top")) * 3 >= F.col("n"))
    return per.groupBy(group).agg(F.avg(F.col("top") / F.col("n")).alias("aggregate"), F.count_if(low).alias("n_low"))
