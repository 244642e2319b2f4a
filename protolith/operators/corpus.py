"""Corpus building: filters, labels, quotas, splits and set operations over ordered rows.

Order is always an explicit column.  Counts along the whole table are summed in
two steps, over stretches of the order and then within one, so that no task
holds all rows.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What strip() removes at the ends of a text.
BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def length_band(df: DataFrame, low: int, high: int, text: str = "text", stripped: bool = True) -> DataFrame:
    """Rows whose text has low to high code points, after or before stripping; a NULL text goes."""
    t = strip(F.col(text)) if stripped else F.col(text)
    return df.filter(F.char_length(t).between(low, high))


def not_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.col(text).isNotNull() & (F.col(text) != ""))


def bands(value: Column, safe_most: float, danger_least: float, strict: bool = False) -> Column:
    """0 up to one edge, 1 from the other, NULL between and for NULL; ``strict`` leaves the edges out."""
    low, high = (value < safe_most, value > danger_least) if strict else (value <= safe_most, value >= danger_least)
    return F.when(low, 0).when(high, 1)


def two_raters(a: Column, b: Column, safe: float, danger: float) -> Column:
    """1 if either rater says danger, 0 if both say safe, else NULL."""
    return F.when((a == danger) | (b == danger), 1).when((a == safe) & (b == safe), 0)


def contains_any(text: Column, words: Sequence[str], word_boundary: bool = False) -> Column:
    """Whether any word is in the lower-cased text, as a substring or as a whole word."""
    low = F.lower(text)
    if word_boundary:
        return low.rlike(r"\b(" + "|".join(f"\\Q{w.lower()}\\E" for w in words) + r")\b")
    return functools.reduce(operator.or_, [low.contains(w.lower()) for w in words])


def multi_label(df: DataFrame, keywords: dict[str, Sequence[str]], default: str = "general", text: str = "text", **options) -> DataFrame:
    """A row for each category whose keywords the text has; ``default`` where none."""
    found = F.filter(F.array(*[F.when(contains_any(F.col(text), w, **options), F.lit(c)) for c, w in keywords.items()]), lambda c: c.isNotNull())
    return df.withColumn("category", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))))


def first_match(text: Column, keywords: dict[str, Sequence[str]], default: str = "general") -> Column:
    """The first category, in the order given, whose keywords the text has."""
    out = F.lit(default)
    for c, w in reversed(list(keywords.items())):
        out = F.when(contains_any(text, w), F.lit(c)).otherwise(out)
    return out


def largest(scores: dict[str, Column], least: float = 0.3, default: str = "general") -> Column:
    """The category of the largest score if over ``least``; NULL counts as 0, the first wins a tie."""
    filled = {c: F.coalesce(s, F.lit(0.0)) for c, s in scores.items()}
    top, out = F.greatest(*filled.values()), F.lit(default)
    for c, s in reversed(list(filled.items())):
        out = F.when(s == top, F.lit(c)).otherwise(out)
    return F.when(top > least, out).otherwise(F.lit(default))


def first_n(df: DataFrame, n: int, by: Sequence[str], order: str = "ord") -> DataFrame:
    """The first n rows of each group in order; Spark cuts each task's groups before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("__rn") <= n).drop("__rn")


def running_counts(df: DataFrame, conditions: dict[str, Column], order: str = "ord", stretch: int = 1 << 16) -> DataFrame:
    """Adds, for each condition, how many rows up to this one meet it (rows with the same order count in one go)."""
    part = df.withColumn("__part", F.floor(F.col(order) / stretch))
    flags = {c: F.coalesce(cond, F.lit(False)).cast("long") for c, cond in conditions.items()}
    totals = part.groupBy("__part").agg(*[F.sum(f).alias(c) for c, f in flags.items()])
    before = Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    offsets = totals.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in conditions])
    inside = Window.partitionBy("__part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    out = part.join(offsets, "__part").withColumns({c: F.col(f"__{c}") + F.sum(f).over(inside) for c, f in flags.items()})
    return out.drop("__part", *[f"__{c}" for c in conditions])


def prefix_until(df: DataFrame, quotas: dict[str, tuple[Column, int]], order: str = "ord") -> DataFrame:
    """Rows up to and including the one at which every quota is met; all rows if that never is."""
    counted = running_counts(df, {f"__{c}_seen": cond for c, (cond, _) in quotas.items()}, order)
    met = functools.reduce(operator.and_, [F.col(f"__{c}_seen") >= n for c, (_, n) in quotas.items()])
    end = counted.filter(met).agg(F.min(order).alias("__end"))
    return counted.crossJoin(F.broadcast(end)).filter(F.col("__end").isNull() | (F.col(order) <= F.col("__end"))).drop("__end", *[f"__{c}_seen" for c in quotas])  # one row


def shuffled(key: str, seed: int) -> Column:
    """A reproducible random order of the keys, the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def first_ranked(df: DataFrame, n: int, key: str = "query_id", seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """The first n rows (of each group) in a reproducible random order, with __rank.

    Every task keeps its first n before anything is sent, so no task holds a group.
    """
    order = (shuffled(key, seed), key)
    if by:
        return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rank") <= n)
    return df.orderBy(*order).limit(n).withColumn("__rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # n rows


def sample(df: DataFrame, n: int, key: str = "query_id", seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """n rows (of each group) without replacement, the same on every run."""
    return first_ranked(df, n, key, seed, by).drop("__rank")


def hash_part(key: str, seed: int, parts: int) -> Column:
    """One of so many disjoint random parts for each key, without an order: the same in every engine that has md5."""
    return (F.conv(F.substring(shuffled(key, seed), 1, 8), 16, 10).cast("long") % parts).cast("int")


def without(df: DataFrame, taken: DataFrame, on: str = "text") -> DataFrame:
    """Rows whose value isn't in ``taken``: every copy of a taken value goes, copies of others stay."""
    return df.join(taken.select(on).distinct(), on, "left_anti")


def overlap(df: DataFrame, other: DataFrame, on: str = "text") -> DataFrame:
    return df.join(other.select(on).distinct(), on, "left_semi")


def train_test(df: DataFrame, train: DataFrame, on: str = "text") -> DataFrame:
    """Both splits by value: (…, split)."""
    return train.withColumn("split", F.lit("train")).unionByName(without(df, train, on).withColumn("split", F.lit("test")))


def lowest(df: DataFrame, rank: Column, most: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of each group (by ``by``) that come first by ``rank``, as many as ``most`` says.

    ``rank``: lower-case hexadecimal text, evenly spread, such as an md5.  ``most``:
    (some of ``by``, __most), a row for each group or for several.  Rows are counted by the first
    three digits of their rank; all in the prefixes before the edge stay, and only the rows of the prefix at the
    edge are ranked, one part in 4096 of a group.
    """
    on = [c for c in most.columns if c != "__most"]
    marked = df.withColumn("__digest", rank).withColumn("__prefix", F.substring("__digest", 1, 3))
    counts = marked.groupBy(*by, "__prefix").agg(F.count(F.lit(1)).alias("__n"))  # 4096 rows for each group at most
    upto = Window.partitionBy(*by).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    edges = counts.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    edges = edges.join(most, on) if on else edges.crossJoin(F.broadcast(most))  # one row
    kept = marked.join(edges.filter(F.col("__before") < F.col("__most")), [*by, "__prefix"])
    whole = F.col("__before") + F.col("__n") <= F.col("__most")
    own = ["__digest", "__prefix", "__n", "__before", "__most"]
    edge = kept.filter(~whole).withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__prefix").orderBy("__digest")))
    return kept.filter(whole).drop(*own).unionByName(edge.filter(F.col("__rn") <= F.col("__most") - F.col("__before")).drop("__rn", *own))


def balanced(df: DataFrame, rank: Column, label: str = "label") -> DataFrame:
    """As many rows of each class as the smaller has, by ``rank`` (as in ``lowest``) within the class."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("__most"))
    return lowest(df, rank, least, (label,))


def union_distinct(*parts: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts).distinct()
