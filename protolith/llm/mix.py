"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time.  Its integral is the
source's cumulative token demand; inverting that demand gives each document (and
each repeat of it) a training position in [0, 1], and a range sort by position
is the training order.  How much a source gives in total is its target.

Sizes are words, maximal runs of ``[^\\x20\\x09-\\x0D]``.  Within a source,
documents stand in the order of the md5 of their id, so a rerun agrees.  A
target of f passes over a source takes every document floor(f) times, and once
more those that lie in the first part of that order; whole documents are taken,
so a source misses its target by at most half of the document at the cut.

Running sums inside a source are taken in two steps, over slices of the md5 order,
as many as leave about ``SLICE_ROWS`` rows in each, and then within a slice, so no
task holds a whole source.  Sums over the sources are taken in ranges likewise.

Defined results: null text has size 0 and is taken 0 times with no position; a
null source is a source of its own, the last; null ids share one place in the
order and are ordered by size; repeated rows are separate documents (``curriculum``
gives all of them the positions of the first); texts of any length count whole.  An
empty table gives an empty result.  Only the named columns are read, so others may
have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolith.llm._common import table, written

WEIGHTS = (5.0, 2.0, 1.0)
#: (time, weight) knots for sources of each weight, in turn: the heavy ones fade, the light ones grow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.75), (1.0, 1.25)), ((0.0, 0.5), (1.0, 1.5)))
SHARE = 1.5
CAP = 2.0
#: Rows of a slice, about; 4096 slices a source at least.
SLICE_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def integrated(knots) -> list[float]:
    """Cumulative demand at each knot of a piecewise linear schedule."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (w0 + w1) / 2 * (t1 - t0))
    return out


def inverse_demand(q: Column, times: Column, weights: Column, demand: Column) -> Column:
    """The time at which the share ``q`` of a source's demand is used up."""
    last = F.size(demand) - 1
    y = q * F.element_at(demand, -1)
    k = F.greatest(F.lit(1), F.least(last, F.size(F.filter(demand, lambda d: d <= y))))
    t0, t1 = F.element_at(times, k), F.element_at(times, k + 1)
    w0, w1 = F.element_at(weights, k), F.element_at(weights, k + 1)
    c = y - F.element_at(demand, k)
    slope = (w1 - w0) / (t1 - t0)
    root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * c, F.lit(0.0)))
    return t0 + F.when(w0 + root > 0, 2 * c / (w0 + root)).otherwise(0.0)


def _ranged(df: DataFrame, order: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each sum, its running total before the row in this order, and its total.

    The rows are dealt into ranges of the order; totals of the ranges, a row for
    each, are summed up first, then the rows inside a range, so no task holds all.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "mix-ranges")
    per = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    every, upto = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__range", *[F.coalesce(F.sum(f"__{n}").over(upto), F.lit(0)).alias(f"__{n}_before") for n in sums], *[F.sum(f"__{n}").over(every).alias(f"{n}_total") for n in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(per, "__range").withColumns({f"{n}_before": F.col(f"__{n}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return out.drop("__range", *[f"__{n}_before" for n in sums])


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, schedules=SCHEDULES) -> DataFrame:
    """Adds weight, target and schedule to (src, source, source_size).

    ``src`` sorts as the sources do, null last.  The water level L solves
    sum(min(cap * size, L * weight)) = share * total; it is found from running sums over
    the sources by the level at which each is full, without iteration.
    """
    named = _ranged(per_source, ("src",), {"place": F.lit(1), "size": F.col("source_size")})
    levels = (
        named.withColumn("turn", F.col("place_before").cast("int"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") % len(weights) + 1))
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("goal", F.col("size_total") * F.lit(share))
        .select("src", "source_size", "turn", "weight", "most", "full_at", "goal")
    )
    filled = _ranged(levels, ("full_at", "turn"), {"most": F.col("most"), "weight": F.col("weight")})
    level = (F.col("goal") - F.col("most_before")) / (F.col("weight_total") - F.col("weight_before"))
    fits = filled.withColumn("level", level).filter(F.col("level") <= F.col("full_at"))
    found = fits.agg(F.min(F.struct("full_at", "turn", "level")).getField("level").alias("level"))
    levels = filled.crossJoin(F.broadcast(found))  # one row
    plan = F.array(*[F.struct(*[F.array(*map(F.lit, map(float, x))).alias(n) for n, x in (("t", [a for a, _ in s]), ("w", [b for _, b in s]), ("d", integrated(s)))]) for s in schedules])
    return levels.select(
        "src", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"), F.element_at(plan, F.col("turn") % len(schedules) + 1).alias("schedule")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, schedules=SCHEDULES, seed: int = 0, keys: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: size, source_size, target, copies, taken, positions.

    ``keys``: further columns to carry, by name.  ``cap`` is at least ``share``.
    """
    if cap < share or len(weights) != len(schedules):
        raise ValueError("cap must be at least share, and there must be a schedule for each weight")
    keys = keys or {}
    ident = F.col(id_col)
    sized = written(
        docs.select(
            ident.alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~")).alias("src"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))).alias("ord"),
            *[c.alias(n) for n, c in keys.items()],
        ),
        "mix-sized",
    )
    digits = max(3, math.ceil(math.log(max(1, sized.count() / SLICE_ROWS), 16)))
    sized = sized.withColumn("slice", F.substring("ord", 1, digits))
    slices = sized.groupBy("src", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("slice_size"))
    goal = targets(slices.groupBy("src").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size")), weights, share, cap, schedules)
    upto = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.select("src", "slice", F.coalesce(F.sum("slice_size").over(upto), F.lit(0)).alias("slice_start")).join(goal, "src")
    inside = Window.partitionBy("src", "slice").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("slice_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    extra = F.col("middle") <= F.col("target") - F.col("passes") * F.col("source_size")
    sched = F.col("schedule")
    where = lambda i: inverse_demand(F.least((i * F.col("source_size") + F.col("middle")) / F.col("target"), F.lit(1.0)), sched["t"], sched["w"], sched["d"])
    return (
        sized.join(placed, ["src", "slice"])
        .withColumn("middle", at)
        .withColumn("passes", passes)
        .withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + extra.cast("int")).otherwise(F.lit(0)))
        .withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), where)).otherwise(F.array().cast("array<double>")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "positions", *keys)
    )


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it.

    The columns are those of ``docs``.  Rows that agree in id, source and text
    share the decision on the first of them; documents of size 0 are not taken.
    """
    own = docs.columns
    print_of = F.xxhash64(F.col(text_col))
    seen = mix(docs, id_col, text_col, source_col, **options, keys={"print": print_of})
    seen = seen.filter("copies > 0").groupBy(F.col("doc_id").alias("__pl_id"), F.col("source").alias("__pl_source"), F.col("print").alias("__pl_print")).agg(F.min("positions").alias("__pl_at"))
    rows = docs.join(seen, F.col(id_col).eqNullSafe(F.col("__pl_id")) & F.col(source_col).eqNullSafe(F.col("__pl_source")) & (print_of == F.col("__pl_print")))
    rows = rows.select(*[F.col(f"`{c}`") for c in own], F.explode("__pl_at").alias("__pl_position"))
    return rows.repartitionByRange(F.col("__pl_position"), F.col(id_col)).sortWithinPartitions("__pl_position", id_col).select(*[F.col(f"`{c}`") for c in own])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, range-sorted by each document's first training position."""
    out = mix(table(spark, sf_dir, "documents"))
    out = out.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("first_position"))
    return out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS ord,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM r),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
g AS (SELECT *, least(most, (SELECT lvl FROM l WHERE lvl <= most / weight ORDER BY most / weight, turn LIMIT 1) * weight)::DOUBLE AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.turn % 3 AS kind,
         (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0)::DOUBLE AS middle,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS passes
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CASE WHEN size > 0 THEN passes + (middle <= target - passes * source_size)::INT ELSE 0 END AS copies,
         CASE kind WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS w0,
         CASE kind WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS slope FROM p)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(2 * least(middle / target, 1.0::DOUBLE) / (w0 + sqrt(w0 * w0 + 2 * slope * least(middle / target, 1.0::DOUBLE))), 9) END AS first_position
FROM c
"""
