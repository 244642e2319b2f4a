"""Scores by similarity to prototypes, decisions, and the monitor that joins both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolith.functions import vectors as V

KEYS = ("layer",)


def score_two(acts: DataFrame, pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds score = cos(vec, safe) - cos(vec, danger).  ``pairs`` has one row for each key and is broadcast by size."""
    scored = acts.join(pairs, list(keys)).withColumn("score", V.cosine(F.col("vec"), F.col("safe")) - V.cosine(F.col("vec"), F.col("danger")))
    return scored.drop("safe", "danger", "vec")


def score_steering(acts: DataFrame, steered: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds score, the projection on the unit steering vector."""
    return acts.join(steered.select(*keys, "steer"), list(keys)).withColumn("score", V.dot(F.col("vec"), F.col("steer"))).drop("steer", "vec")


def category_scores(acts: DataFrame, cats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each query and category: cat_score."""
    right = cats.select(*keys, F.col("cat").alias("cat_seen"), F.col("vec").alias("cat_vec"))
    return acts.join(right, list(keys)).withColumn("cat_score", V.cosine(F.col("vec"), F.col("cat_vec"))).drop("cat_vec", "vec")


def score_category(acts: DataFrame, cats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds score, the largest category score, and detected, its category; the first wins a tie, none where score <= 0."""
    best = F.min(F.struct((-F.col("cat_score")).alias("minus"), F.col("cat_seen"))).alias("best")
    out = category_scores(acts, cats, keys).groupBy("query_id", "label", *keys).agg(best)
    score = -F.col("best.minus")
    return out.select("query_id", "label", *keys, score.alias("score"), F.when(score > 0, F.col("best.cat_seen")).alias("detected"))


def decide(score: Column, threshold: Column | float = 0.0, names: tuple = (0, 1), higher_is: str = "safe") -> Column:
    """names[0] for safe, names[1] for dangerous; a score at the threshold isn't above it."""
    if higher_is not in ("safe", "dangerous"):
        raise ValueError("higher_is is 'safe' or 'dangerous'")
    above, below = names if higher_is == "safe" else names[::-1]
    return F.when(score > threshold, F.lit(above)).otherwise(F.lit(below))


NAMED = ("PROCEED", "REFUSED")
CLASSES = ("Safe", "Dangerous")


def correct_named(label: Column, decision: Column) -> Column:
    """Whether a class name and a decision agree across their two vocabularies."""
    return ((label == "Safe") & (decision == "PROCEED")) | ((label == "Dangerous") & (decision == "REFUSED"))


def predicted(scored: DataFrame, threshold: Column | float = 0.0, higher_is: str = "safe") -> DataFrame:
    """Adds prediction and correct."""
    return scored.withColumn("prediction", decide(F.col("score"), threshold, higher_is=higher_is)).withColumn("correct", F.col("prediction") == F.col("label"))


@dataclass(frozen=True)
class Monitor:
    """Scores rows with one layer's prototypes; the same expressions on a batch and on a stream."""

    pairs: DataFrame
    layer: int = 0
    threshold: float = 0.0

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds decision, difference, safe and confidence to rows that have ``vec``."""
        one = self.pairs.filter(F.col("layer") == self.layer).select("safe", "danger")
        found = rows.crossJoin(F.broadcast(one))  # one row: the prototypes of one layer
        diff = V.cosine(F.col("vec"), F.col("safe")) - V.cosine(F.col("vec"), F.col("danger"))
        found = found.withColumn("difference", diff).drop("safe", "danger")
        return found.withColumns({"decision": decide(F.col("difference"), self.threshold, NAMED), "safe": F.col("difference") > self.threshold, "confidence": F.abs(F.col("difference") - self.threshold)})
