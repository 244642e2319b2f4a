"""Decision thresholds: midpoint, grids, and the exact optimum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protolith.functions.vectors import grid_point

KEYS = ("layer",)


def midpoint(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, threshold): half way between the least safe and the largest dangerous score."""
    low, high = F.min(F.when(F.col("label") == 0, F.col("score"))), F.max(F.when(F.col("label") == 1, F.col("score")))
    return scored.groupBy(*keys).agg(((low + high) / 2).alias("threshold"))


def curve(scored: DataFrame, low: float | None = None, high: float | None = None, n: int = 200, margin: float = 0.0, keys: Sequence[str] = KEYS, strict_below: bool = False, higher_is: str = "safe") -> DataFrame:
    """(keys, idx, t, accuracy) at every point of a grid, in one pass over the scores.

    The grid runs from low to high, or where they are None over each key's range
    of scores widened by ``margin``.  A score is mapped to the number of grid
    points below it; the counts by that number and label are summed up along the
    grid, so the cost is scores plus grid points and not their product.
    strict_below: a score under t is dangerous, so one at t is safe; otherwise
    one at t is dangerous.
    """
    if low is None or high is None:
        span = scored.groupBy(*keys).agg((F.min("score") - margin).alias("lo"), (F.max("score") + margin).alias("hi"))
    else:
        span = scored.select(*keys).distinct().withColumns({"lo": F.lit(float(low)), "hi": F.lit(float(high))})
    on = list(keys)
    s, lo, hi = F.col("score"), F.col("lo"), F.col("hi")
    at = lambda k: grid_point(k, lo, hi, n)
    below = (lambda k: at(k) <= s) if strict_below else (lambda k: at(k) < s)
    guess = F.when(hi > lo, F.greatest(F.lit(1), F.least(F.lit(n - 1), F.ceil((s - lo) / ((hi - lo) / (n - 1)))))).otherwise(F.lit(1)).cast("int")
    # the guess may be off by rounding: settle on the number of grid points that are below
    k = F.col("k")
    settled = F.when((k + 1 <= n - 1) & below(k + 1), k + 2).when(below(k), k + 1).when(below(k - 1), k).when((k >= 2) & below(k - 2), k - 1).otherwise(F.lit(0))
    rows = scored.join(span, on).withColumn("k", guess)
    far = F.when(~below(F.lit(0)), F.lit(0)).when(below(F.lit(n - 1)), F.lit(n)).otherwise(settled)
    hist = rows.withColumn("above", far).groupBy(*keys, "above").agg(F.sum((F.col("label") == 0).cast("long")).alias("safe"), F.sum((F.col("label") == 1).cast("long")).alias("danger"))
    grid = span.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n)))).select(*keys, "lo", "hi", F.col("idx").alias("above"))
    upto = Window.partitionBy(*keys).orderBy("above").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    filled = grid.join(hist, [*on, "above"], "left").fillna(0, ["safe", "danger"])
    # at grid point idx, the scores above it are those with more than idx points below
    total_safe, total = F.sum("safe").over(whole), F.sum(F.col("safe") + F.col("danger")).over(whole)
    safe_low, danger_low = F.sum("safe").over(upto), F.sum("danger").over(upto)
    right = total_safe - safe_low + danger_low
    if higher_is == "dangerous":
        right = total - right
    out = filled.withColumn("accuracy", right / total).filter(F.col("above") < n)
    return out.select(*keys, F.col("above").alias("idx"), at(F.col("above")).alias("t"), "accuracy")


def best(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, idx, t, accuracy): the point of most accuracy, the lowest where several tie."""
    pick = F.min(F.struct((-F.col("accuracy")).alias("minus"), "idx", "t")).alias("x")
    return points.groupBy(*keys).agg(pick).select(*keys, "x.idx", "x.t", (-F.col("x.minus")).alias("accuracy"))


def product(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """Every score against every point of a small grid: (…, idx, t, correct).  ``curve`` gives the same accuracies without the product."""
    hit = F.when(F.col("score") > F.col("t"), 0).otherwise(1) == F.col("label")
    return scored.crossJoin(F.broadcast(grid)).withColumn("correct", hit)  # the grid has a fixed number of points


def exact_optimum(scored: DataFrame, keys: Sequence[str] = KEYS, stretches: int = 4096) -> DataFrame:
    """(keys, threshold, accuracy) over all thresholds that tell the scores apart: each distinct score, from below.

    Counts run along the scores in two steps, over equal stretches of their range and
    then within one, so no task sorts all scores of a key.
    """
    on = list(keys)
    by = scored.groupBy(*on, "score").agg(F.sum((F.col("label") == 0).cast("long")).alias("safe"), F.sum((F.col("label") == 1).cast("long")).alias("danger"))
    span = by.groupBy(*on).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("safe").alias("all_safe"), F.sum("danger").alias("all_danger"))
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * stretches)).otherwise(F.lit(0))
    by = by.join(span, on).withColumn("part", place)
    totals = by.groupBy(*on, "part").agg(F.sum("safe").alias("s"), F.sum("danger").alias("d"))
    before = Window.partitionBy(*on).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # stretches + 1 rows a key at most
    totals = totals.select(*on, "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("s", "d")])
    inside = Window.partitionBy(*on, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    pts = by.join(totals, [*on, "part"]).withColumns({"safe_low": F.col("s_before") + F.sum("safe").over(inside), "danger_low": F.col("d_before") + F.sum("danger").over(inside)})
    right = F.col("danger_low") + F.col("all_safe") - F.col("safe_low")
    pts = pts.withColumn("accuracy", right / (F.col("all_safe") + F.col("all_danger")))
    pick = F.min(F.struct((-F.col("accuracy")).alias("minus"), F.col("score"))).alias("x")
    return pts.groupBy(*on).agg(pick).select(*on, F.col("x.score").alias("threshold"), (-F.col("x.minus")).alias("accuracy"))


def at_best(scored: DataFrame, found: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, Column]:
    """The scores with each key's best threshold joined on, and that threshold's column."""
    return scored.join(found.select(*keys, F.col("t").alias("threshold")), list(keys)), F.col("threshold")
