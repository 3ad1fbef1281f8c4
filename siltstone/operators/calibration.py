"""Fitted models of acceptance: logistic risk, conformal ranks, thresholds, drift of a calibration."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.stats import ks, running, sigmoid, spread
from siltstone.sources.scratch import written


def feature(c: Column) -> Column:
    """A feature as a number: booleans as 0 and 1, missing as 0."""
    return F.coalesce(c.cast("double"), F.lit(0.0))


def risk(weights: list[float], bias: float, *features: Column) -> Column:
    """Logistic probability; 0.5 if weights and features differ in number."""
    if len(weights) != len(features):
        return F.lit(0.5)
    z: Column = F.lit(float(bias))
    for w, x in zip(weights, features, strict=True):
        z = z + w * x
    return sigmoid(z)


def fit_logistic(rows: DataFrame, features: list[str], label: str, rounds: int = 8, ridge: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias by Newton steps. Each step is one aggregation of as many sums as there are pairs of features, whatever the number of rows; rows count so that both labels weigh the same."""
    import numpy as np

    names = [*features, "_one"]
    data = rows.select(*[feature(F.col(c)).alias(c) for c in features], F.lit(1.0).alias("_one"), F.col(label).cast("double").alias("_y")).filter("_y IS NOT NULL")
    data = written(data, "features")  # each step reads these columns alone
    total = data.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p")).first()
    if not total["n"] or total["p"] in (0, total["n"]):
        return [0.0] * len(features), 0.0
    n, p = total["n"], total["p"]
    weight = F.when(F.col("_y") == 1, n / (2 * p)).otherwise(n / (2 * (n - p)))
    beta = np.zeros(len(names))
    for _ in range(rounds):
        prob = risk([float(b) for b in beta], 0.0, *[F.col(c) for c in names])
        scored = data.withColumns({"_p": prob, "_w": weight})
        slope = [F.sum(F.col("_w") * (F.col("_y") - F.col("_p")) * F.col(a)) for a in names]
        curve = [F.sum(F.col("_w") * F.col("_p") * (1 - F.col("_p")) * F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
        got = list(scored.agg(*[c.alias(f"s{i}") for i, c in enumerate([*slope, *curve])]).first())
        h = np.zeros((len(names), len(names)))
        h[np.triu_indices(len(names))] = got[len(names) :]
        h = h + np.triu(h, 1).T + ridge * np.eye(len(names))
        beta = beta + np.linalg.solve(h, np.array(got[: len(names)]) - ridge * beta)
    return [float(b) for b in beta[:-1]], float(beta[-1])


def conformal(scores: DataFrame, calibration: DataFrame, keys: list[str], id_col: str, score: str) -> DataFrame:
    """``id, p``: (calibration scores strictly above it + 1) / (calibration scores + 1), per key; the score itself where a key has no calibration scores.

    Ranks come from one ordered pass over both tables, dealt by ranges, not from comparing pairs.
    """
    own = scores.select(*keys, F.col(id_col).alias("id"), F.col(score).alias("s"), F.lit(0).alias("m"))
    seen = calibration.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("m"))
    both = own.unionByName(seen.withColumn("id", F.lit(None).cast(scores.schema[id_col].dataType)))
    rows = running(both.withColumn("asked", F.col("m") == 0), keys, ["s"], {"c": F.col("m")}).filter("asked")
    p = (F.col("c_all") - F.col("c") + 1) / (F.col("c_all") + 1)
    return rows.select(*keys, "id", F.when(F.col("c_all") == 0, F.col("s").cast("double")).otherwise(p).alias("p"))


def escalates(p: Column, alpha: float, entropy: Column | None = None, threshold: float | None = None) -> Column:
    """A candidate is escalated if its p-value is under ``alpha``, or its entropy, where it and a threshold are known, over the threshold."""
    low = F.coalesce(p < alpha, F.lit(False))
    return low if entropy is None or threshold is None else low | F.coalesce(entropy > threshold, F.lit(False))


def halves(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``half``: 0 for the first half of the rows, rounded down, 1 for the rest; ``order`` is unique."""
    rows = running(df, [], order, {"_i": F.lit(1)})
    return rows.withColumn("half", F.when(F.col("_i") * 2 <= F.col("_i_all"), 0).otherwise(1)).drop("_i", "_i_all")


def nonconformity(prob: Column, label: Column) -> Column:
    """How atypical a labelled row is: 1 less the probability of its label, ``prob`` being that of label 1."""
    return F.when(label.cast("double") == 1, 1 - prob).otherwise(prob)


def fit_conformal(rows: DataFrame, features: list[str], label: str, order: list[str]) -> tuple[list[float], float, DataFrame]:
    """A logistic model of the first half of the rows, and the scores (``score``) of the second, against which ``conformal`` ranks."""
    dealt = written(halves(rows.filter(F.col(label).isNotNull()), order), "halves")
    weights, bias = fit_logistic(dealt.filter("half = 0"), features, label)
    prob = risk(weights, bias, *[feature(F.col(c)) for c in features])
    return weights, bias, dealt.filter("half = 1").select(nonconformity(prob, F.col(label)).alias("score"))


def save_model(spark: SparkSession, path: str, weights: list[float], bias: float, features: list[str], scores: DataFrame | None = None, **settings: object) -> None:
    """Writes a model as one row of JSON, and a conformal model's ``scores`` as a table beside it."""
    model = {"coefficients": weights, "intercept": bias, "feature_keys": features, **settings} | ({} if scores is None else {"type": "conformal"})
    if scores is not None:
        scores.select("score").write.mode("overwrite").parquet(f"{path}/scores")
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_model(spark: SparkSession, path: str, conformal_only: bool = False) -> dict | None:
    """A saved model, with ``scores`` as a table if it is conformal; None if there is none, it isn't readable, or it isn't conformal where that is asked for."""
    try:
        lines = spark.read.text(f"{path}/model").limit(2).collect()
        model = json.loads(lines[0]["value"]) if len(lines) == 1 else None
        if not isinstance(model, dict) or not isinstance(model.get("coefficients"), list) or (conformal_only and model.get("type") != "conformal"):
            return None
        model = {"coefficients": [float(w) for w in model["coefficients"]], "intercept": float(model.get("intercept", 0.0)), "feature_keys": list(model.get("feature_keys", [])), "threshold": float(model.get("threshold", 0.7)), "alpha": float(model.get("alpha", 0.1)), "type": model.get("type", "logistic"), "entropy_threshold": model.get("entropy_threshold")}
        return model | ({"scores": spark.read.parquet(f"{path}/scores")} if model["type"] == "conformal" else {})
    except (AnalysisException, ValueError, TypeError):
        return None


def predicted(rows: DataFrame, model: dict) -> Column:
    """The probability of label 1 by a loaded model; features that ``rows`` lacks count as missing."""
    return risk(model["coefficients"], model["intercept"], *[feature(F.col(c)) if c in rows.columns else F.lit(0.0) for c in model["feature_keys"]])


def upper_quantile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Per key: the observed value at or above the quantile (no interpolation)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("quantile")).agg(F.count(F.lit(1)).alias("m"))
    rows = running(counts, keys, ["quantile"], {"upto": F.col("m")})
    at = F.ceil(F.lit(share) * (F.col("upto_all") - 1))
    return rows.filter((F.col("upto") > at) & (F.col("upto") - F.col("m") <= at)).select(*keys, "quantile")


def best_threshold(df: DataFrame, score: str, label: str, steps: int = 20) -> DataFrame:
    """F1 of each threshold 1/steps .. (steps-1)/steps, from a histogram of scores: ``threshold, f1``."""
    cells = df.groupBy(F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps)).alias("cell")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1, steps).withColumnRenamed("id", "cell").withColumns({"pos": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "_g": F.lit(1)})
    both = cells.withColumn("_g", F.lit(0)).unionByName(grid).groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.max("_g").alias("_g"))
    above = Window.orderBy(F.desc("cell"))  # at most steps + 1 rows
    whole = Window.partitionBy()
    f1 = F.try_divide(2 * F.sum("pos").over(above), F.sum("n").over(above) + F.sum("pos").over(whole))
    return both.withColumn("f1", F.coalesce(f1, F.lit(0.0))).filter("_g = 1").select((F.col("cell") / steps).alias("threshold"), "f1")


def drift(current: DataFrame, baseline: DataFrame, keys: list[str], value: str, shift: float = 2.0, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Per key: how median and spread moved between two samples, and whether either moved too far: by more than ``shift`` robust deviations, or out of a band of ratios."""
    a = spread(current, keys, value).select(*keys, F.col("mid").alias("mid"), F.col("mad").alias("mad"))
    b = spread(baseline, keys, value).select(*keys, F.col("mid").alias("mid0"), F.col("mad").alias("mad0"))
    moved = F.col("mid") - F.col("mid0")
    ratio = F.when(F.col("mad0") > 0, F.col("mad") / F.col("mad0")).when(F.col("mad") > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    rows = a.join(b, keys).select(*keys, moved.alias("median_shift"), ratio.alias("mad_ratio"), F.greatest(1.345 * F.col("mad0"), F.lit(1e-3)).alias("unit"))
    located, spreads = F.abs("median_shift") > shift * F.col("unit"), ~F.col("mad_ratio").between(low, high)
    return rows.select(*keys, "median_shift", "mad_ratio", located.alias("location_drift"), spreads.alias("spread_drift"))


def separation(df: DataFrame, keys: list[str], value: str, related: Column) -> DataFrame:
    """How far two classes of scores lie apart: the largest distance of their distributions."""
    return ks(df, keys, value, related)
