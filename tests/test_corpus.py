import pytest
from pyspark.sql import functions as F

from protolith.operators import corpus as C
from protolith.sources import tables as T
from protolith.sources.embedder import HashingEmbedder, embed


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "query_id long, text string")


def ids(df):
    return sorted(r.query_id for r in df.collect())


def test_length_before_and_after_strip(spark):
    df = texts(spark, "  " + "a" * 9, "\t" + "a" * 10 + "\n", "fav\x0b\x0c" + "b" * 9, None)
    assert ids(C.length_band(df, 10, 200)) == [1, 2]
    assert ids(C.length_band(df, 10, 200, stripped=False)) == [0, 1, 2]
    assert df.select(C.strip(F.lit("\x0cfav\x0b\n ")).alias("x")).first().x == "fav"


def test_band_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.7,), (0.29,), (0.71,), (0.5,), (None,)], "v double")
    assert [r.x for r in df.select(C.bands(F.col("v"), 0.3, 0.7).alias("x")).collect()] == [0, 1, 0, 1, None, None]
    assert [r.x for r in df.select(C.bands(F.col("v"), 0.3, 0.7, strict=True).alias("x")).collect()] == [None, None, 0, 1, None, None]


def test_two_raters(spark):
    df = spark.createDataFrame([(5.0, 1.0), (1.0, 5.0), (1.0, 1.0), (1.0, 3.0)], "a double, b double")
    assert [r.x for r in df.select(C.two_raters(F.col("a"), F.col("b"), 1.0, 5.0).alias("x")).collect()] == [1, 1, 0, None]


def test_default_is_for_an_absent_column_only(spark):
    df = spark.createDataFrame([(1, None)], "id int, a double")
    row = T.with_defaults(df, {"a": 5.0, "b": 5.0}).first()
    assert row.a is None and row.b == 5.0


def test_keywords(spark):
    df = texts(spark, "He begun to LAUGH", "plain", "lsd", "a gun")
    words = {"arms": ("gun",), "drugs": ("LSD",), "fun": ("laugh",)}
    got = {(r.query_id, r.category) for r in C.multi_label(df, words).collect()}
    assert got == {(0, "arms"), (0, "fun"), (1, "general"), (2, "drugs"), (3, "arms")}
    assert ids(df.filter(C.contains_any(F.col("text"), ["gun"], word_boundary=True))) == [3]
    assert [r.x for r in df.select(C.first_match(F.col("text"), words).alias("x")).collect()] == ["arms", "general", "drugs", "arms"]


def test_largest_score_category(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.1, 0.3), (None, None), (None, 0.4)], "a double, b double")
    assert [r.x for r in df.select(C.largest({"a": F.col("a"), "b": F.col("b")}).alias("x")).collect()] == ["a", "general", "general", "b"]


ROWS = [0, 0, 1, 0, 0, 1, 0, 1, 0]


def ordered(spark):
    return spark.createDataFrame([(i, y) for i, y in enumerate(ROWS)], "query_id long, label int")


def test_quota(spark):
    assert ids(C.first_n(ordered(spark), 2, ("label",), "query_id")) == [0, 1, 2, 5]


@pytest.mark.parametrize("stretch", [1, 2, 100])
def test_prefixes(spark, stretch):
    df = ordered(spark)
    counted = C.running_counts(df, {"n": F.col("label") == 1}, "query_id", stretch).orderBy("query_id").collect()
    assert [r.n for r in counted] == [0, 0, 1, 1, 1, 2, 2, 3, 3]
    both = {"safe": (F.col("label") == 0, 2), "danger": (F.col("label") == 1, 2)}
    assert ids(C.prefix_until(df, both, "query_id")) == [0, 1, 2, 3, 4, 5]
    assert ids(C.prefix_until(df, {"danger": (F.col("label") == 1, 9)}, "query_id")) == list(range(9))


def test_anti_join_by_value_removes_all_copies_of_a_taken_text(spark):
    df = texts(spark, "a", "a", "b", "b", "c")
    train = df.filter("query_id = 0")
    assert ids(C.without(df, train)) == [2, 3, 4]
    assert ids(C.overlap(df, train)) == [0, 1]
    assert C.train_test(df, train).groupBy("split").count().count() == 2


def test_sample_and_balance_agree_on_every_run(spark):
    df = ordered(spark).repartition(3)
    assert ids(C.sample(df, 4)) == ids(C.sample(df.repartition(2), 4)) and len(ids(C.sample(df, 4))) == 4
    kept = C.balanced(df, C.shuffled("query_id", 42)).groupBy("label").count().collect()
    assert {r["count"] for r in kept} == {3}


def test_union_distinct(spark):
    assert C.union_distinct(texts(spark, "a").select("text"), texts(spark, "a", "b").select("text")).count() == 2


def test_sources_that_fail_are_reported(spark, tmp_path):
    good = texts(spark, "a")
    load = {"good": lambda: good, "bad": lambda: spark.read.parquet(str(tmp_path / "none"))}
    out, skipped = T.union_sources(load, on_error="skip")
    assert out.count() == 1 and list(skipped) == ["bad"]
    with pytest.raises(Exception):
        T.union_sources(load)
    with pytest.raises(ValueError):
        T.union_sources({"bad": load["bad"]}, on_error="skip")


def test_csv_round_trip_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("q, 1", True, 0.5), ("q2", False, -1.0)], "query string, correct boolean, score double")
    T.write_csv(df, str(tmp_path / "c"))
    back = T.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    calls = []
    make = lambda: calls.append(1) or df
    for refresh in (False, False, True):
        assert T.cached(spark, str(tmp_path / "p"), make, refresh).count() == 2
    assert len(calls) == 2


def test_embedder_pools_own_tokens_only(spark):
    df = texts(spark, "a b", "a b " + "a b " * 40, None)
    got = {(r.query_id, r.layer): r.vec for r in embed(df, HashingEmbedder()).collect()}
    assert len(got) == 12 and got[0, 0] == pytest.approx(got[1, 0]) and set(got[2, 1]) == {0.0}
    assert len({tuple(got[0, k]) for k in range(4)}) > 1
