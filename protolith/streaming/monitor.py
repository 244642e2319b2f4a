"""The monitor on a stream: the batch expressions, stateless, so any sink and trigger will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolith.functions import vectors as V
from protolith.operators.scoring import NAMED, decide


def score_stream(rows: DataFrame, pairs: DataFrame, layer: int = 0, threshold: float = 0.0) -> DataFrame:
    """Adds difference, decision, safe and confidence to streamed rows that have ``vec``.

    The prototypes of one layer are one row; it is read once and becomes part of the plan.
    """
    one = pairs.filter(F.col("layer") == layer).select("safe", "danger").first()  # one row
    if one is None:
        raise ValueError(f"no prototypes for layer {layer}")
    lit = lambda v: F.array(*map(F.lit, v))
    diff = V.cosine(F.col("vec"), lit(one.safe)) - V.cosine(F.col("vec"), lit(one.danger))
    out = rows.withColumn("difference", diff)
    return out.withColumns({"decision": decide(F.col("difference"), threshold, NAMED), "safe": F.col("difference") > threshold, "confidence": F.abs(F.col("difference") - threshold)})
