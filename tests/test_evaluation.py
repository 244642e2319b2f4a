import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from protolith.operators import ensembles as E
from protolith.operators import metrics as M
from protolith.operators import scoring as S
from protolith.operators import thresholds as T


def scores(spark, rows):
    return spark.createDataFrame([(i, float(s), y) for i, (s, y) in enumerate(rows)], "query_id long, score double, label int").withColumn("layer", F.lit(0))


def predictions(spark, rows):
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(rows)], "query_id long, label int, prediction int")
    return df.withColumn("layer", F.lit(0)).withColumn("correct", F.col("label") == F.col("prediction"))


def test_a_score_at_the_threshold_refuses(spark):
    df = scores(spark, [(0.1, 0), (0.2, 0)])
    assert [r.d for r in df.select(S.decide(F.col("score"), 0.1, S.NAMED).alias("d")).collect()] == ["REFUSED", "PROCEED"]
    assert [r.d for r in df.select(S.decide(F.col("score"), 0.1, higher_is="dangerous").alias("d")).collect()] == [0, 1]


def test_named_decisions_across_vocabularies(spark):
    rows = spark.createDataFrame([("Safe", "PROCEED"), ("Safe", "REFUSED"), ("Dangerous", "REFUSED"), ("Dangerous", "PROCEED")], "l string, d string")
    assert [r.ok for r in rows.select(S.correct_named(F.col("l"), F.col("d")).alias("ok")).collect()] == [True, False, True, False]


def test_the_lowest_of_tied_thresholds_wins(spark):
    best = T.best(T.curve(scores(spark, [(-1, 1), (1, 0)]), -0.05, 0.05, 200)).first()
    assert (best.idx, best.t, best.accuracy) == (0, -0.05, 1.0)


@pytest.mark.parametrize("strict_below", [False, True])
@pytest.mark.parametrize("higher_is", ["safe", "dangerous"])
def test_curve_equals_the_product(spark, strict_below, higher_is):
    rng = np.random.default_rng(1)
    grid = np.array([-0.03 + k * (0.06 / 29) for k in range(29)] + [0.03])
    values = np.concatenate([rng.normal(0, 0.03, 80), grid[[0, 3, 29]], [-9, 9]])
    labels = rng.integers(0, 2, len(values))
    got = T.curve(scores(spark, list(zip(values.tolist(), labels.tolist(), strict=True))), -0.03, 0.03, 30, strict_below=strict_below, higher_is=higher_is).orderBy("idx").collect()
    for r, t in zip(got, grid, strict=True):
        above = values >= t if strict_below else values > t
        wrong = (above if higher_is == "safe" else ~above) == (labels == 1)
        assert r.accuracy == pytest.approx(1 - wrong.mean()), r


def test_curve_over_the_range_of_scores(spark):
    got = T.curve(scores(spark, [(1, 1), (2, 0), (3, 0)]), n=5, margin=0.5).orderBy("idx").collect()
    assert [r.t for r in got] == [0.5, 1.25, 2.0, 2.75, 3.5] and got[1].accuracy == 1.0
    one = T.curve(scores(spark, [(1, 1), (1, 0)]), n=5).collect()  # no range at all
    assert {r.accuracy for r in one} == {0.5}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.integers(0, 1)), min_size=2, max_size=30))
def test_no_grid_beats_the_exact_optimum(spark, rows):
    df = scores(spark, rows)
    assert T.best(T.curve(df, n=40)).first().accuracy <= T.exact_optimum(df).first().accuracy + 1e-12


def test_midpoint(spark):
    assert T.midpoint(scores(spark, [(0.4, 0), (0.9, 0), (0.1, 1), (-0.5, 1)])).first().threshold == pytest.approx(0.25)


def test_recorded_confusion(spark):
    """Of 40 texts: 18 safe ones passed, 2 refused, 1 dangerous one passed, 19 refused."""
    pred = predictions(spark, [(0, 0)] * 18 + [(0, 1)] * 2 + [(1, 0)] + [(1, 1)] * 19)
    c = M.confusion(pred).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (18, 2, 1, 19)
    m = {r.cls: r for r in M.class_metrics(pred).collect()}
    assert m[0].precision == pytest.approx(18 / 19) and m[0].recall == pytest.approx(0.9) and m[1].recall == pytest.approx(0.95)
    assert M.accuracy(pred).first().accuracy == pytest.approx(0.925)
    assert M.weighted_f1(M.class_metrics(pred)).first().weighted_f1 == pytest.approx((m[0].f1 + m[1].f1) / 2)


def test_metrics_without_positives_are_zero(spark):
    m = {r.cls: r for r in M.class_metrics(predictions(spark, [(0, 0), (1, 0)])).collect()}
    assert (m[1].precision, m[1].recall, m[1].f1) == (0, 0, 0)


def test_a_split_vote_passes(spark):
    rows = [(1, 1, layer, p) for layer, p in enumerate((0, 0, 1, 1))] + [(2, 1, layer, p) for layer, p in enumerate((0, 1, 1, 1))]
    df = spark.createDataFrame(rows, "query_id int, label int, layer int, prediction int")
    assert {r.query_id: r.prediction for r in E.majority_vote(df).collect()} == {1: 0, 2: 1}


def test_histogram_puts_the_largest_in_the_last_bin(spark):
    values = np.random.default_rng(2).normal(size=200)
    got = {r.bin: r.n for r in M.histogram(scores(spark, [(v, 0) for v in values])).collect()}
    want = np.histogram(values, 50)[0]
    assert got == {k: n for k, n in enumerate(want.tolist()) if n}


def test_trend_and_failures(spark):
    assert [spark.range(1).select(M.trend(F.lit(a), F.lit(b)).alias("x")).first().x for a, b in ((0.5, 0.6), (0.6, 0.5), (0.5, 0.54))] == ["improving", "declining", "stable"]
    pred = predictions(spark, [(0, 1), (1, 0), (0, 0), (0, 1)])
    assert [(r.query_id, r.error_type, r.rank) for r in M.first_examples(M.failures(pred), 1, ("error_type",), "query_id").orderBy("query_id").collect()] == [(0, "FP", 1), (1, "FN", 1)]


def test_first_category_wins_a_tie_and_none_at_or_below_zero(spark):
    acts = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [-1.0, 0.0])], "query_id int, label int, vec array<double>").withColumn("layer", F.lit(0))
    cats = spark.createDataFrame([(5, [2.0, 0.0]), (3, [1.0, 0.0])], "cat int, vec array<double>").withColumn("layer", F.lit(0))
    assert {r.query_id: r.detected for r in S.score_category(acts, cats).collect()} == {1: 3, 2: None}


def test_monitor(spark):
    pairs = spark.createDataFrame([(0, [1.0, 0.0], [0.0, 1.0])], "layer int, safe array<double>, danger array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, vec array<double>")
    got = {r.query_id: r for r in S.Monitor(pairs, threshold=0.5).score(rows).collect()}
    assert got[1].decision == "PROCEED" and got[1].confidence == pytest.approx(0.5) and got[2].decision == "REFUSED" and not got[2].safe
