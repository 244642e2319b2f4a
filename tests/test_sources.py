"""Readers, accessors, the console table, selection by rank, and the stand-in embedder, on literal rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from protolith.operators import corpus as C
from protolith.operators import thresholds
from protolith.plans.report_queries import layer_subset
from protolith.sources import tables as T
from protolith.sources.embedder import HashingEmbedder, embed


def test_any_format_is_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    for form in ("parquet", "json", "orc"):
        df.write.format(form).save(str(tmp_path / form))
        assert sorted(map(repr, T.read_any(spark, str(tmp_path / form), form, df.schema).collect())) == sorted(map(repr, df.collect()))


def test_caches_are_invalidated(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    T.cached(spark, one, lambda: spark.range(3).toDF("id"))
    assert T.invalidate(spark, one, two) == [one]
    assert T.cached(spark, one, lambda: spark.range(5).toDF("id")).count() == 5


def test_text_of_a_string_a_struct_or_neither(spark):
    rows = spark.sql("SELECT 'a' AS plain, named_struct('text', 'b', 'x', 1) AS nested, named_struct('y', 'c') AS other, array('d') AS list")
    got = rows.select(*[T.text_field(rows, c).alias(c) for c in rows.columns]).first()
    assert tuple(got) == ("a", "b", None, None)


def test_console_table_shows_whole_values(spark):
    out = T.console(spark.createDataFrame([(1, "x" * 40)], "id long, text string"))
    assert "x" * 40 in out and out.startswith("+--") and "|id |text" in out


@pytest.mark.parametrize("most", [0, 1, 7, 500, 999, 5000])
def test_lowest_equals_a_ranking_of_all(spark, most):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("cls"))
    need = spark.createDataFrame([(0, most), (1, most // 2)], "cls long, __most long")
    got = {r.id for r in C.lowest(df, C.shuffled("id", 3), need, ("cls",)).collect()}
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
    assert got == {i for k, n in ((0, most), (1, most // 2)) for i in [j for j in order if j % 2 == k][:n]}


def test_first_ranked_and_parts(spark):
    df = spark.range(300)
    got = {r["id"]: r["__rank"] for r in C.first_ranked(df, 20, "id").collect()}
    order = sorted(range(300), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert got == {i: k + 1 for k, i in enumerate(order[:20])}
    parts = {r["id"]: r.p for r in df.select("id", C.hash_part("id", 5, 3).alias("p")).collect()}
    assert parts == {i: int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:8], 16) % 3 for i in range(300)}


@pytest.mark.parametrize("stretches", [1, 7, 4096])
def test_exact_optimum_equals_brute_force(spark, stretches):
    rows = [(0, ((i * 37) % 101) / 50 - 1 + (0.3 if i % 3 else -0.3), int(i % 3 == 0)) for i in range(200)] + [(1, 0.5, 0), (1, 0.5, 1)]
    got = {r.layer: (r.threshold, r.accuracy) for r in thresholds.exact_optimum(spark.createDataFrame(rows, "layer int, score double, label int"), stretches=stretches).collect()}
    for layer in (0, 1):
        own = [(s, y) for k, s, y in rows if k == layer]
        best = max(((sum((0 if s > t else 1) == y for s, y in own) / len(own), -t) for t in {s for s, _ in own}))
        assert got[layer] == pytest.approx((-best[1], best[0]))


def test_layer_subset():
    assert layer_subset(28) == [0, 1, 7, 14, 21, 26, 27] and layer_subset(4) == [0, 1, 2, 3]


def test_embedder_against_its_definition(spark):
    texts = [(1, "The cat  the\ndog"), (2, ""), (3, None), (4, "a " * 300), (5, "éÉ x")]
    got = {(r.query_id, r.layer): r.vec for r in embed(spark.createDataFrame(texts, "query_id long, text string"), HashingEmbedder()).collect()}
    for i, t in texts:
        words = [w for w in (t or "").lower().replace("\n", " ").split(" ") if w][:128]
        for layer in range(4):
            want = [0.0] * 16
            for w in words:
                h = int(hashlib.md5(f"{layer}:{w}".encode()).hexdigest()[:8], 16)
                want[h % 16] += 1 if h >> 16 & 1 else -1
            assert got[i, layer] == pytest.approx([x / max(1, len(words)) for x in want])


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace as N

    from protolith.sources.scratch import work_path, work_root

    def session(master, named=None, set_=None):
        folder = N(isEmpty=lambda: set_ is None, get=lambda: set_)
        return N(sparkContext=N(master=master, getConf=lambda: {"spark.checkpoint.dir": named}, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: folder))))

    assert work_root(session("spark://m:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert work_root(session("yarn", None, "hdfs://z")) == "hdfs://z"
    with pytest.raises(RuntimeError):
        work_root(session("yarn"))
    assert work_path(spark, "a") != work_path(spark, "a")
