"""Connected components by hooking to the least neighbour and contracting, all in tables.

A round hooks every node to its least neighbour if that is smaller, shortens the
chains until every node points at a root, and replaces the ends of each edge by
their roots.  Stars vanish in one round and long chains in about log n; the
tables shrink with every round.  Once ``FEW_EDGES`` edges or fewer are left, one task
joins them in memory, which saves the last rounds.  Nothing is gathered on the driver
but counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolith.llm._common import discard, written


#: Edges that one task joins in memory.
FEW_EDGES = 1 << 17


def _joined(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of at most ``FEW_EDGES`` edges, by a union-find forest in one task."""
    kind = dict(edges.dtypes)["a"]

    def run(batches):
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        arrow = None
        for batch in batches:
            arrow = batch.schema.field("a").type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), arrow), pa.array([find(x) for x in list(up)], arrow)], names=["id", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"id {kind}, root {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component is its least reachable id."""
    left = written(edges.filter("a <> b").select("a", "b"), "cc-edges")
    labels = None
    while n := left.count():
        roots = written(_joined(left), "cc-roots") if n <= FEW_EDGES else _contracted(left)
        point = roots.select("id", "root")
        if labels is None:
            new = written(point.withColumnRenamed("root", "component"), "cc-labels")
        else:
            to = point.select(F.col("id").alias("component"), "root")
            new = written(labels.join(to, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "cc-labels")
            discard(labels)
        labels = new
        if n <= FEW_EDGES:
            discard(left, roots)
            return labels
        a, b = point.select(F.col("id").alias("a"), F.col("root").alias("ra")), point.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        fewer = left.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct()
        fewer = written(fewer, "cc-edges")
        discard(left, roots)
        left = fewer
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    discard(left)
    return labels


def _contracted(edges: DataFrame) -> DataFrame:
    """(id, root): every node hooked to its least neighbour, and chains shortened until all point at a root."""
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).union(edges.select("b", "a"))
    roots = written(ends.groupBy("id").agg(F.least(F.col("id"), F.min("near")).alias("root")), "cc-roots")
    while True:
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        jumped = written(roots.select("id", "root").join(up, "root").select("id", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), "cc-jump")
        discard(roots)
        roots = jumped
        if jumped.filter("moved").isEmpty():
            return roots
