"""Ensembles over layers, from a long table of scores; no join by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolith.operators import metrics, thresholds


def majority_vote(pred: DataFrame) -> DataFrame:
    """(query_id, label, votes, prediction): dangerous if more than half of the layers say so."""
    out = pred.groupBy("query_id", "label").agg(F.sum("prediction").alias("votes"), F.count(F.lit(1)).alias("layers"))
    out = out.withColumn("prediction", F.when(F.col("votes") > F.col("layers") / 2, 1).otherwise(0))
    return out.withColumn("correct", F.col("prediction") == F.col("label"))


def weighted_scores(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, label, score): the layers' scores summed by the weights of (layer, weight)."""
    return scored.join(weights, "layer").groupBy("query_id", "label").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))


def accuracy_weights(pred: DataFrame) -> DataFrame:
    return metrics.accuracy(pred).select("layer", F.col("accuracy").alias("weight"))


def smart(scored: DataFrame, pred: DataFrame, optimised: DataFrame, k: int = 3) -> DataFrame:
    """Scores of the k layers that do best at their own best threshold, weighted by their accuracy at 0."""
    top = metrics.ranked(optimised, "accuracy", "layer", k).select("layer")
    return weighted_scores(scored, accuracy_weights(pred).join(top, "layer", "left_semi"))


def evaluate(ensemble: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """One row: the best grid threshold of an ensemble's scores."""
    keyed = ensemble.withColumn("layer", F.lit(0))
    return thresholds.best(thresholds.curve(keyed, low, high, n))
