import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from protolith.functions import vectors as V
from protolith.operators import prototypes as P

SMALL = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 1.0]), (3, 1, [0.0, 1.0]), (4, 1, [-1.0, 1.0])]


@pytest.fixture(scope="module")
def small_vectors(spark):
    return spark.createDataFrame(SMALL, "query_id int, label int, vec array<double>").withColumn("layer", F.lit(0))


def value(spark, expr, **cols):
    df = spark.range(1).select(*[F.array(*map(F.lit, map(float, v))).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first().x


def test_cosine_of_a_zero_vector_is_zero(spark):
    assert value(spark, V.cosine(F.col("a"), F.col("b")), a=[0, 0], b=[1, 2]) == 0.0


def test_unit_of_a_zero_vector_stays(spark):
    assert value(spark, V.unit(F.col("a")), a=[0, 0]) == [0.0, 0.0]


def test_algebra(spark):
    assert value(spark, V.dot(F.col("a"), F.col("b")), a=[1, 2], b=[3, 4]) == 11
    assert value(spark, V.norm(F.col("a")), a=[3, 4]) == 5
    assert value(spark, V.subtract(F.col("a"), F.col("b")), a=[3, 4], b=[1, 1]) == [2, 3]
    assert value(spark, V.scale(F.col("a"), F.lit(2.0)), a=[3, 4]) == [6, 8]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=3), st.lists(st.floats(-5, 5), min_size=3, max_size=3), st.floats(0.1, 9))
def test_cosine_is_symmetric_and_ignores_scale(spark, a, b, k):
    df = spark.createDataFrame([(a, b, [k * x for x in a])], "a array<double>, b array<double>, c array<double>")
    x, y, z = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("b"), F.col("a")), V.cosine(F.col("c"), F.col("b"))).first()
    assert x == pytest.approx(y)
    assert x == pytest.approx(z, abs=1e-6) or np.linalg.norm(a) < 1e-100


def test_linspace_equals_numpy(spark):
    got = [r.t for r in V.linspace(spark, -0.03, 0.03, 150).orderBy("idx").collect()]
    assert np.allclose(got, np.linspace(-0.03, 0.03, 150), atol=1e-15) and got[-1] == 0.03


def test_means_and_steering(small_vectors):
    row = P.steering(P.paired(P.mean_prototypes(small_vectors, dim=2))).first()
    assert row.safe == [1.0, 0.5] and row.danger == [-0.5, 1.0]
    assert row.magnitude == pytest.approx(np.hypot(1.5, 0.5))
    assert row.steer == pytest.approx([1.5 / np.hypot(1.5, 0.5), -0.5 / np.hypot(1.5, 0.5)])


def test_separations_are_distinct_measures(spark, small_vectors):
    pairs = P.paired(P.mean_prototypes(small_vectors, dim=2)).withColumns({"sp": F.array(F.lit(1.0), F.lit(0.0)), "dp": F.array(F.lit(0.0), F.lit(1.0))})
    get = lambda kind: pairs.select(P.separation(kind, F.col("safe"), F.col("danger"), F.col("sp"), F.col("dp")).alias("x")).first().x
    assert get("cos") == pytest.approx(0.0) and get("one_minus_cos") == pytest.approx(1.0)
    assert get("two_probe") == pytest.approx(3 / np.sqrt(5) + 1 / np.sqrt(5))  # the safe probe leans by 2 + 1, the dangerous one by 2 - 1
    with pytest.raises(ValueError):
        get("other")


def test_equal_members_share_the_weight(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0])], "query_id int, label int, vec array<double>").withColumn("layer", F.lit(0))
    s = P.weight_summary(rows, dim=2).first()
    assert s.min_weight == pytest.approx(0.5) and s.max_weight == pytest.approx(0.5)
    assert P.weighted_prototypes(rows, dim=2).first().vec == pytest.approx([1.0, 2.0])


def test_small_categories_are_skipped(spark):
    rows = [(i, 1, 7, [1.0, float(i)]) for i in range(5)] + [(9, 1, 8, [1.0, 0.0])] + [(20, 0, 0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id int, label int, cat int, vec array<double>").withColumn("layer", F.lit(0))
    assert [r.cat for r in P.category_vectors(df, dim=2).collect()] == [7]


def test_scoring_plan_has_no_python_and_no_collecting(spark, small):
    from protolith.plans.evaluation_queries import scored

    plan = scored(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
