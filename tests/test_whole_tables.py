"""Queries that must read and return all of a table, against plain Python."""

from protolith.plans.catalog import QUERIES
from protolith.sources import tables as T


def test_text_lower_whole_keeps_what_follows_the_first_200_code_points(spark, small):
    texts = {r.doc_id: r.text for r in T.read(spark, small, "documents").collect()}
    got = {r.query_id: r.low for r in QUERIES["text_lower"](spark, small).collect()}
    assert got == {i: t.lower() for i, t in texts.items()}
    assert sum(map(len, got.values())) > sum(len(t[:200]) for t in texts.values())


def test_vec_series_whole_has_every_vector(spark, small):
    sizes = {r.vec_id: len(r.embedding) for r in T.read(spark, small, "embeddings").collect()}
    got = {r.query_id: r["count"] for r in QUERIES["vec_series"](spark, small).groupBy("query_id").count().collect()}
    assert got == sizes and any(i % 10 for i in got)


def test_report_corpus_whole_reads_documents_past_the_scan_limit(spark, tmp_path):
    rows = [(i, "a text of some length, long enough", "s") for i in (1, 2, 800, 900)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [r.n for r in QUERIES["report_corpus"](spark, str(tmp_path)).collect()] == [4]


def test_union_distinct_whole_has_long_texts_and_unknown_lengths(spark, tmp_path):
    rows = [(1, "short", 5), (2, "x" * 400, 400), (3, "y" * 900, 900), (4, "unknown", None), (5, "short", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "short"), (2, "item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(r.text for r in QUERIES["union_distinct"](spark, str(tmp_path)).collect())
    assert got == sorted({r[1] for r in rows} | {"item"})
