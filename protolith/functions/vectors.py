"""Vector algebra as column expressions over ARRAY<DOUBLE>; no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has length 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def unit(a: Column) -> Column:
    """The vector over its length; a vector of length 0 stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def mean(vec: Column, dim: int) -> Column:
    """Elementwise mean: one partial and one final hash aggregate, no explode."""
    return F.array(*[F.avg(F.get(vec, F.lit(i))) for i in range(dim)])


def weighted_mean(vec: Column, weight: Column, dim: int) -> Column:
    """Elementwise sum(w * x) / sum(w)."""
    return F.array(*[F.sum(weight * F.get(vec, F.lit(i))) / F.sum(weight) for i in range(dim)])


def confidence(vec: Column, centre: Column, sharpness: float = 5.0) -> Column:
    """Unnormalised softmax weight of a member; a cosine is at most 1, so exp can't overflow."""
    return F.exp(sharpness * cosine(vec, centre))


def rounded(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits)


def rounded_all(vec: Column, digits: int = 6) -> Column:
    return F.transform(vec, lambda x: F.round(x, digits))


def linspace(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """(idx, t): an inclusive grid whose last point is exactly ``high``."""
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), grid_point(F.col("id"), F.lit(low), F.lit(high), n).alias("t"))


def grid_point(idx: Column, low: Column, high: Column, n: int) -> Column:
    return F.when(idx == n - 1, high).otherwise(low + idx * ((high - low) / (n - 1)))
