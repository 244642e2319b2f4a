"""Class prototypes: means, weighted means, differences and how far apart they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolith.functions import vectors as V
from protolith.sources.tables import LAYER_DIM

KEYS = ("layer",)


def mean_prototypes(train: DataFrame, keys: Sequence[str] = KEYS, cls: str = "label", dim: int = LAYER_DIM) -> DataFrame:
    """(keys, cls, vec, n): the elementwise mean of each class."""
    return train.groupBy(*keys, cls).agg(V.mean(F.col("vec"), dim).alias("vec"), F.count(F.lit(1)).alias("n"))


def member_weights(train: DataFrame, keys: Sequence[str] = KEYS, cls: str = "label", dim: int = LAYER_DIM) -> DataFrame:
    """The rows of ``train`` with ``raw``, each member's unnormalised softmax weight in its class."""
    centre = mean_prototypes(train, keys, cls, dim).select(*keys, cls, F.col("vec").alias("centre"))
    return train.join(centre, [*keys, cls]).withColumn("raw", V.confidence(F.col("vec"), F.col("centre")))


def weighted_prototypes(train: DataFrame, keys: Sequence[str] = KEYS, cls: str = "label", dim: int = LAYER_DIM) -> DataFrame:
    """(keys, cls, vec, n): the softmax-weighted mean of each class, in one aggregate."""
    rows = member_weights(train, keys, cls, dim)
    return rows.groupBy(*keys, cls).agg(V.weighted_mean(F.col("vec"), F.col("raw"), dim).alias("vec"), F.count(F.lit(1)).alias("n"))


def weight_summary(train: DataFrame, keys: Sequence[str] = KEYS, cls: str = "label", dim: int = LAYER_DIM) -> DataFrame:
    """Least, largest and mean normalised weight of each class: aggregates of the raw weights over their sum."""
    raw, total = F.col("raw"), F.sum("raw")
    return member_weights(train, keys, cls, dim).groupBy(*keys, cls).agg((F.min(raw) / total).alias("min_weight"), (F.max(raw) / total).alias("max_weight"), (F.avg(raw) / total).alias("avg_weight"))


def paired(protos: DataFrame, keys: Sequence[str] = KEYS, cls: str = "label") -> DataFrame:
    """(keys, safe, danger): both classes' vectors in a row."""
    pick = lambda k: F.first(F.when(F.col(cls) == k, F.col("vec")), ignorenulls=True)
    return protos.groupBy(*keys).agg(pick(0).alias("safe"), pick(1).alias("danger"))


def steering(pairs: DataFrame) -> DataFrame:
    """Adds ``steer``, the unit difference of the two means, and its length before scaling."""
    diff = V.subtract(F.col("safe"), F.col("danger"))
    return pairs.withColumn("diff", diff).withColumn("magnitude", V.norm(F.col("diff"))).withColumn("steer", V.unit(F.col("diff"))).drop("diff")


def tone_vector(acts: DataFrame, first_id: int, second_id: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, tone, magnitude): the difference of two single rows."""
    one = lambda i, n: acts.filter(F.col("query_id") == i).select(*keys, F.col("vec").alias(n))
    return one(first_id, "x").join(one(second_id, "y"), list(keys)).select(*keys, V.subtract(F.col("x"), F.col("y")).alias("tone")).withColumn("magnitude", V.norm(F.col("tone")))


def category_vectors(train: DataFrame, least: int = 5, keys: Sequence[str] = KEYS, dim: int = LAYER_DIM) -> DataFrame:
    """(keys, cat, vec, separation, n): mean of each dangerous category less the safe mean.

    Categories with fewer than ``least`` examples are skipped.
    """
    safe = train.filter("label = 0").groupBy(*keys).agg(V.mean(F.col("vec"), dim).alias("safe"))
    cats = train.filter("label = 1").groupBy(*keys, "cat").agg(V.mean(F.col("vec"), dim).alias("centre"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    joined = cats.join(safe, list(keys))
    return joined.select(*keys, "cat", V.subtract(F.col("centre"), F.col("safe")).alias("vec"), V.cosine(F.col("centre"), F.col("safe")).alias("separation"), "n")


def separation(kind: str, safe: Column, danger: Column, safe_probe: Column | None = None, danger_probe: Column | None = None) -> Column:
    """Five measures that are never to be mixed in a table.

    probe: how much two probes differ in their leaning to the class each is of;
    two_probe: how far both probes lean each way; cos: similarity of the means (1 means alike);
    one_minus_cos: their distance; category: similarity of a category's mean to the safe mean.
    """
    if kind in ("cos", "category"):
        return V.cosine(safe, danger)
    if kind == "one_minus_cos":
        return 1 - V.cosine(safe, danger)
    if kind == "probe":
        return F.abs(V.cosine(safe_probe, safe) - V.cosine(danger_probe, danger))
    if kind == "two_probe":
        return F.abs(V.cosine(safe_probe, safe) - V.cosine(safe_probe, danger)) + F.abs(V.cosine(danger_probe, danger) - V.cosine(danger_probe, safe))
    raise ValueError(f"no separation {kind}")
