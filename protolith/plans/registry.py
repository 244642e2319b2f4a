"""Where queries register, and the SQL that they share with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its DuckDB SQL."""

    def register(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


#: Canonical views.  w: whole vectors; act: long by layer.
W = """w AS (SELECT vec_id AS query_id, CASE WHEN label < 5 THEN 0 ELSE 1 END AS label, label AS cat,
    CASE WHEN vec_id % 10 = 0 THEN 'train' ELSE 'test' END AS split, embedding::DOUBLE[] AS vec FROM embeddings)"""
ACT = f"""{W}, act AS (SELECT query_id, label, cat, split, l::INT AS layer, list_slice(vec, 16 * l + 1, 16 * l + 16) AS vec FROM w, range(4) r(l))"""


def cos(a: str, b: str) -> str:
    """Cosine, 0 for a vector of length 0."""
    return f"(CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0::DOUBLE ELSE list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


def means(name: str, source: str, keys: str, where: str = "TRUE", weight: str | None = None) -> str:
    """A CTE (keys, vec): elementwise mean, or sum(w * x) / sum(w)."""
    agg = f"sum({weight} * vec[i]) / sum({weight})" if weight else "avg(vec[i])"
    return f"{name} AS (SELECT {keys}, list(m ORDER BY i) AS vec FROM (SELECT {keys}, i, {agg} AS m FROM {source}, range(1, 17) r(i) WHERE {where} GROUP BY {keys}, i) GROUP BY {keys})"


def pairs(name: str, protos: str) -> str:
    """A CTE (layer, safe, danger)."""
    return f"{name} AS (SELECT s.layer, s.vec AS safe, d.vec AS danger FROM {protos} s JOIN {protos} d ON s.layer = d.layer WHERE s.label = 0 AND d.label = 1)"


TRAIN = "split = 'train'"
#: pm, pr: class means of the training rows by layer; sc: scores of all rows against them.
PROTO = f"{ACT}, {means('pm', 'act', 'layer, label', TRAIN)}, {pairs('pr', 'pm')}"
SCORES = f"{PROTO}, sc AS (SELECT a.query_id, a.layer, a.label, a.cat, a.split, {cos('a.vec', 'p.safe')} - {cos('a.vec', 'p.danger')} AS score FROM act a JOIN pr p ON a.layer = p.layer)"
TEST = f"{SCORES}, ts AS (SELECT * FROM sc WHERE split = 'test')"
PRED = f"{TEST}, pd AS (SELECT *, CASE WHEN score > 0 THEN 0 ELSE 1 END AS prediction, (CASE WHEN score > 0 THEN 0 ELSE 1 END) = label AS correct FROM ts)"


def grid(name: str, low: float, high: float, n: int) -> str:
    return f"{name} AS (SELECT idx::INT AS idx, CASE WHEN idx = {n - 1} THEN {high}::DOUBLE ELSE {low}::DOUBLE + idx * (({high}::DOUBLE - {low}::DOUBLE) / {n - 1}) END AS t FROM range({n}) r(idx))"


def sweep(name: str, scores: str, grid_name: str, keys: str = "layer") -> str:
    """A CTE (keys, idx, t, accuracy) by the product of scores and grid."""
    return f"{name} AS (SELECT {keys}, idx, t, avg(CASE WHEN (CASE WHEN score > t THEN 0 ELSE 1 END) = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM {scores}, {grid_name} GROUP BY {keys}, idx, t)"


def best_of(name: str, sweep_name: str, keys: str = "layer") -> str:
    return f"{name} AS (SELECT {keys}, idx, t, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY accuracy DESC, idx) AS rn FROM {sweep_name}) WHERE rn = 1)"
