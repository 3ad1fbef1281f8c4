"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import gathered, sized, written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b``: the smallest of its component.

    First each node's smaller neighbours are tied to the smallest of them, which leaves a node one edge and ties those
    that it had in common only once. Then each round takes the smallest label among a node's neighbours, and that label's
    own label, so labels travel twice as far each round; it ends when no label changes, after some log2 of the longest
    path rounds. Everything stays in tables: joins and groupings with map-side combination, written to the shared folder
    in each round. No edges give no rows; repeated edges are fine, and a loop, or a node that has only loops, is left out.
    """
    pairs = written(gathered(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    n = pairs.count()
    low = pairs.groupBy("a").agg(F.min("b").alias("low"))
    thin = written(sized(pairs.join(low, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct().unionByName(low.select("a", F.col("low").alias("b"))), n), "thin")
    links = thin.union(thin.select("b", "a"))
    labels = links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"), F.lit(True).alias("changed"))
    labels = written(sized(labels, 2 * n), "labels")
    while labels.filter("changed").limit(1).count():
        near = links.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.select("node", F.col("label").alias("old")).join(near, "node").withColumn("label", F.least("old", "near"))
        owner = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(owner, "label").select("node", F.least("label", "up").alias("label"), (F.least("label", "up") != F.col("old")).alias("changed"))
        labels = written(sized(step, 2 * n), "labels")
    return labels.select("node", "label")
