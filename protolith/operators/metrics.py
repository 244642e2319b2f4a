"""Evaluation: accuracy, confusion, precision and recall, distributions, failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("layer",)


def hits(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, label, n, n_correct, recall)."""
    return pred.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), hits(F.col("correct")).alias("n_correct"), F.avg(F.col("correct").cast("double")).alias("recall"))


def confusion(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, tn, fp, fn, tp) with dangerous as the positive class, in one pass."""
    y, p = F.col("label"), F.col("prediction")
    return pred.groupBy(*keys).agg(hits((y == 0) & (p == 0)).alias("tn"), hits((y == 0) & (p == 1)).alias("fp"), hits((y == 1) & (p == 0)).alias("fn"), hits((y == 1) & (p == 1)).alias("tp"))


def class_metrics(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, cls, precision, recall, f1, support) for both classes."""
    c = confusion(pred, keys)
    one = lambda cls, right, wrong, missed: F.struct(F.lit(cls).alias("cls"), ratio(right, right + wrong).alias("precision"), ratio(right, right + missed).alias("recall"), ratio(2 * right, 2 * right + wrong + missed).alias("f1"), (right + missed).alias("support"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    both = F.explode(F.array(one(0, tn, fn, fp), one(1, tp, fp, fn)))
    return c.withColumn("m", both).select(*keys, "m.*")


def weighted_f1(metrics: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, weighted_f1) by the classes' actual supports."""
    return metrics.groupBy(*keys).agg(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def confusion_matrix(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, label, pred_0, pred_1)."""
    return pred.groupBy(*keys, "label").agg(hits(F.col("prediction") == 0).alias("pred_0"), hits(F.col("prediction") == 1).alias("pred_1"))


def histogram(scored: DataFrame, bins: int = 50, keys: Sequence[str] = KEYS, by: Sequence[str] = ("label",)) -> DataFrame:
    """(keys, by, bin, n): equal widths over each key's range, the last bin closed."""
    span = scored.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / width))).otherwise(F.lit(0)).cast("int")
    return scored.join(span, list(keys)).groupBy(*keys, *by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def failures(pred: DataFrame) -> DataFrame:
    """Wrong rows with error_type: FP for a safe row refused, FN for a dangerous row passed."""
    return pred.filter(~F.col("correct")).withColumn("error_type", F.when(F.col("label") == 0, "FP").otherwise("FN"))


def first_examples(rows: DataFrame, n: int, by: Sequence[str], order: str) -> DataFrame:
    """The first n rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def ranked(report: DataFrame, score: str, tie: str, k: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds rank, by score descending and then ``tie``; keeps the first k."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a report: a row for each layer or model
    out = report.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), F.asc(tie))))
    return out if k is None else out.filter(F.col("rank") <= k)


def trend(first: Column, last: Column, by: float = 0.05) -> Column:
    return F.when(last > first + by, "improving").when(last < first - by, "declining").otherwise("stable")
