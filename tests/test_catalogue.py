"""Every registered query against its SQL on the smallest tables, and the driver's entry points."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from protolith.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return out


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert as_rows(df.columns, map(tuple, df.collect())) == as_rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_driver_contract(spark):
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_under_test", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    assert mod.entry(spark).count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert set(QUERIES) <= set(mod.queries())


def test_streamed_scores_equal_batch_scores(spark, small, tmp_path):
    from protolith.plans.vector_queries import mean_pairs
    from protolith.plans.vector_queries import test as test_rows
    from protolith.streaming.monitor import score_stream

    rows = test_rows(spark, small).filter("layer = 0").select("query_id", "vec")
    rows.write.parquet(str(tmp_path / "in"))
    pairs = mean_pairs(spark, small)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, pairs, layer=0, threshold=0.0).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.query_id: (r.decision, round(r.difference, 9)) for r in spark.table("scored").collect()}
    from protolith.operators.scoring import Monitor

    want = {r.query_id: (r.decision, round(r.difference, 9)) for r in Monitor(pairs).score(rows).collect()}
    assert got == want
