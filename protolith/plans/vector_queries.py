"""Vector functions, prototypes and separations over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolith.functions import vectors as V
from protolith.operators import metrics
from protolith.operators import prototypes as P
from protolith.plans.registry import ACT, PROTO, TRAIN, W, cos, means, query, r6
from protolith.sources import tables as T

REF = "ref AS (SELECT vec AS rv FROM w WHERE query_id = 0)"


def train(spark, sf) -> DataFrame:
    return T.activations(spark, sf).filter("split = 'train'")


def test(spark, sf) -> DataFrame:
    return T.activations(spark, sf).filter("split = 'test'")


def mean_pairs(spark, sf) -> DataFrame:
    return P.paired(P.mean_prototypes(train(spark, sf)))


def against_first(spark, sf) -> DataFrame:
    """Every vector beside that of query 0."""
    w = T.vectors(spark, sf)
    return w.crossJoin(F.broadcast(w.filter("query_id = 0").select(F.col("vec").alias("rv"))))  # one row


@query(f"WITH {W}, {REF} SELECT query_id, {r6(cos('vec', 'rv'))} AS cosine FROM w, ref")
def vec_cosine(spark, sf):
    return against_first(spark, sf).select("query_id", V.rounded(V.cosine(F.col("vec"), F.col("rv"))).alias("cosine"))


@query(f"WITH {W}, {REF} SELECT query_id, {r6('list_inner_product(vec, rv)')} AS dot FROM w, ref")
def vec_dot(spark, sf):
    return against_first(spark, sf).select("query_id", V.rounded(V.dot(F.col("vec"), F.col("rv"))).alias("dot"))


@query(f"WITH {ACT} SELECT query_id, layer, {r6('sqrt(list_inner_product(vec, vec))')} AS norm FROM act")
def vec_norm(spark, sf):
    return T.activations(spark, sf).select("query_id", "layer", V.rounded(V.norm(F.col("vec"))).alias("norm"))


@query(f"WITH {ACT} SELECT query_id, layer, (i - 1)::INT AS dim, {r6('vec[i] / sqrt(list_inner_product(vec, vec))')} AS x FROM act, range(1, 17) r(i)")
def vec_unit(spark, sf):
    return T.activations(spark, sf).select("query_id", "layer", F.posexplode(V.unit(F.col("vec"))).alias("dim", "x")).withColumn("x", V.rounded(F.col("x")))


@query(f"WITH {W} SELECT query_id, dim, x FROM (SELECT query_id, (i - 1)::INT AS dim, {r6('vec[i]')} AS x, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec[i]) DESC, i) AS rn FROM w, range(1, 65) r(i)) WHERE rn <= 20")
def vec_topdims(spark, sf):
    """The 20 largest components by absolute value, within each row's array."""
    parts = F.transform("vec", lambda x, i: F.struct((-F.abs(x)).alias("minus"), i.alias("dim"), x.alias("x")))
    top = F.slice(F.array_sort(parts), 1, 20)
    return T.vectors(spark, sf).select("query_id", F.explode(top).alias("p")).select("query_id", "p.dim", V.rounded(F.col("p.x")).alias("x"))


@query(f"WITH {W} SELECT query_id, (i - 1)::INT AS dim, {r6('vec[i]')} AS x FROM w, range(1, 65) r(i)")
def vec_series(spark, sf):
    return T.vectors(spark, sf).select("query_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", V.rounded(F.col("x")))


@query(f"WITH {ACT} SELECT query_id, layer, {r6('vec[1]')} AS first_x, {r6('vec[16]')} AS last_x FROM act WHERE layer IN (0, 3)")
def layer_pick(spark, sf):
    return T.activations(spark, sf, (0, 3)).select("query_id", "layer", V.rounded(F.col("vec")[0]).alias("first_x"), V.rounded(F.col("vec")[15]).alias("last_x"))


@query("SELECT idx::INT AS idx, CASE WHEN idx = 149 THEN 0.03::DOUBLE ELSE (-0.03)::DOUBLE + idx * ((0.03::DOUBLE - (-0.03)::DOUBLE) / 149) END AS t FROM range(150) r(idx)")
def linspace_grid(spark, sf):
    return V.linspace(spark, -0.03, 0.03, 150)


WEIGHTS = f"{ACT}, {means('cm', 'act', 'layer, label', TRAIN)}, wt AS (SELECT a.query_id, a.layer, a.label, a.vec, exp(5 * {cos('a.vec', 'c.vec')}) AS raw FROM act a JOIN cm c ON a.layer = c.layer AND a.label = c.label WHERE a.split = 'train')"
EXPANDED = "SELECT layer, label, (i - 1)::INT AS dim, {x} AS x FROM {p}, range(1, 17) r(i)"


@query(f"WITH {WEIGHTS} SELECT query_id, layer, {r6('raw / sum(raw) OVER (PARTITION BY layer, label)')} AS weight FROM wt")
def softmax_weights(spark, sf):
    rows = P.member_weights(train(spark, sf))
    total = rows.groupBy("layer", "label").agg(F.sum("raw").alias("total"))
    return rows.join(total, ["layer", "label"]).select("query_id", "layer", V.rounded(F.col("raw") / F.col("total")).alias("weight"))


def _expanded(protos: DataFrame) -> DataFrame:
    return protos.select("layer", "label", F.posexplode("vec").alias("dim", "x")).withColumn("x", V.rounded(F.col("x")))


@query(f"WITH {PROTO} {EXPANDED.format(x=r6('vec[i]'), p='pm')}")
def proto_mean(spark, sf):
    return _expanded(P.mean_prototypes(train(spark, sf)))


@query(f"WITH {WEIGHTS}, {means('wm', 'wt', 'layer, label', weight='raw')} {EXPANDED.format(x=r6('vec[i]'), p='wm')}")
def proto_weighted(spark, sf):
    return _expanded(P.weighted_prototypes(train(spark, sf)))


@query(f"WITH {WEIGHTS} SELECT layer, label, {r6('min(raw) / sum(raw)')} AS min_weight, {r6('max(raw) / sum(raw)')} AS max_weight, {r6('avg(raw) / sum(raw)')} AS avg_weight FROM wt GROUP BY layer, label")
def weight_summary(spark, sf):
    out = P.weight_summary(train(spark, sf))
    return out.select("layer", "label", *[V.rounded(F.col(c)).alias(c) for c in ("min_weight", "max_weight", "avg_weight")])


@query(f"WITH {ACT}, d AS (SELECT x.layer, i, x.vec[i] - y.vec[i] AS v FROM act x JOIN act y ON x.layer = y.layer, range(1, 17) r(i) WHERE x.query_id = 0 AND y.query_id = 1) SELECT layer, (i - 1)::INT AS dim, {r6('v')} AS x, {r6('sqrt(sum(v * v) OVER (PARTITION BY layer))')} AS magnitude FROM d")
def tone_vector(spark, sf):
    out = P.tone_vector(T.activations(spark, sf), 0, 1)
    return out.select("layer", V.rounded(F.col("magnitude")).alias("magnitude"), F.posexplode("tone").alias("dim", "x")).withColumn("x", V.rounded(F.col("x")))


STEER = f"{PROTO}, df AS (SELECT layer, i, safe[i] - danger[i] AS v FROM pr, range(1, 17) r(i)), st AS (SELECT layer, list(v / m ORDER BY i) AS steer, max(m) AS magnitude FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY layer)) AS m FROM df) GROUP BY layer)"


@query(f"WITH {STEER} SELECT layer, (i - 1)::INT AS dim, {r6('steer[i]')} AS x, {r6('magnitude')} AS magnitude FROM st, range(1, 17) r(i)")
def steering_vector(spark, sf):
    out = P.steering(mean_pairs(spark, sf))
    return out.select("layer", V.rounded(F.col("magnitude")).alias("magnitude"), F.posexplode("steer").alias("dim", "x")).withColumn("x", V.rounded(F.col("x")))


#: Categories learn from every second vector, or most have too few examples.
CATS = f"""{ACT}, ev AS (SELECT * FROM act WHERE query_id % 2 = 0), {means('sf', 'ev', 'layer', 'label = 0')}, {means('cx', 'ev', 'layer, cat', 'label = 1')},
cn AS (SELECT layer, cat, count(*) AS n FROM ev WHERE label = 1 GROUP BY layer, cat HAVING count(*) >= 5),
cv AS (SELECT cx.layer, cx.cat, n, {cos('cx.vec', 'sf.vec')} AS separation, (SELECT list(cx.vec[i] - sf.vec[i] ORDER BY i) FROM range(1, 17) r(i)) AS vec FROM cx JOIN cn ON cx.layer = cn.layer AND cx.cat = cn.cat JOIN sf ON cx.layer = sf.layer)"""


def cat_vectors(spark, sf) -> DataFrame:
    return P.category_vectors(T.activations(spark, sf).filter("query_id % 2 = 0"))


@query(f"WITH {CATS} SELECT layer, cat, n, {r6('separation')} AS separation, (i - 1)::INT AS dim, {r6('vec[i]')} AS x FROM cv, range(1, 17) r(i)")
def category_vectors(spark, sf):
    return cat_vectors(spark, sf).select("layer", "cat", "n", V.rounded(F.col("separation")).alias("separation"), F.posexplode("vec").alias("dim", "x")).withColumn("x", V.rounded(F.col("x")))


PROBES = f"{PROTO}, pb AS (SELECT p.layer, p.safe, p.danger, x.vec AS sp, y.vec AS dp FROM pr p JOIN act x ON x.layer = p.layer AND x.query_id = 1 JOIN act y ON y.layer = p.layer AND y.query_id = 2)"


def probed(spark, sf) -> DataFrame:
    acts = T.activations(spark, sf)
    one = lambda i, n: acts.filter(F.col("query_id") == i).select("layer", F.col("vec").alias(n))
    return mean_pairs(spark, sf).join(one(1, "sp"), "layer").join(one(2, "dp"), "layer")


def _separation(spark, sf, kind: str) -> DataFrame:
    return probed(spark, sf).select("layer", V.rounded(P.separation(kind, F.col("safe"), F.col("danger"), F.col("sp"), F.col("dp"))).alias("separation"))


SEP_PROBE = f"abs({cos('sp', 'safe')} - {cos('dp', 'danger')})"
SEP_TWO = f"abs({cos('sp', 'safe')} - {cos('sp', 'danger')}) + abs({cos('dp', 'danger')} - {cos('dp', 'safe')})"


@query(f"WITH {PROBES} SELECT layer, {r6(SEP_PROBE)} AS separation FROM pb")
def separation_probe(spark, sf):
    return _separation(spark, sf, "probe")


@query(f"WITH {PROBES} SELECT layer, {r6(SEP_TWO)} AS separation FROM pb")
def separation_two_probe(spark, sf):
    return _separation(spark, sf, "two_probe")


@query(f"WITH {PROBES} SELECT layer, {r6(cos('safe', 'danger'))} AS separation FROM pb")
def separation_cos(spark, sf):
    return _separation(spark, sf, "cos")


@query(f"WITH {PROBES} SELECT layer, {r6('1 - ' + cos('safe', 'danger'))} AS separation FROM pb")
def separation_one_minus_cos(spark, sf):
    return _separation(spark, sf, "one_minus_cos")


@query(f"WITH {CATS} SELECT layer, cat, {r6('separation')} AS separation FROM cv")
def separation_category(spark, sf):
    return cat_vectors(spark, sf).select("layer", "cat", V.rounded(F.col("separation")).alias("separation"))


@query(f"WITH {ACT}, d AS (SELECT x.layer, sum((x.vec[i] - y.vec[i]) ** 2) AS q FROM act x JOIN act y ON x.layer = y.layer, range(1, 17) r(i) WHERE x.query_id = 0 AND y.query_id = 1 GROUP BY x.layer) SELECT layer, {r6('sqrt(q)')} AS magnitude FROM d")
def report_tone_layers(spark, sf):
    return P.tone_vector(T.activations(spark, sf), 0, 1).select("layer", V.rounded(F.col("magnitude")).alias("magnitude"))


LAYER_SCAN = f"SELECT layer, {r6(SEP_TWO)} AS separation, {r6('(SELECT sqrt(sum((safe[i] - danger[i]) ** 2)) FROM range(1, 17) r(i))')} AS magnitude FROM pb"


@query(f"WITH {PROBES}, l AS ({LAYER_SCAN.replace(SEP_TWO, SEP_PROBE)}) SELECT *, (row_number() OVER (ORDER BY separation DESC, layer))::INT AS rank FROM l")
def report_layer_probe(spark, sf):
    return _layer_report(spark, sf, "probe")


@query(f"WITH {PROBES}, l AS ({LAYER_SCAN}) SELECT *, (row_number() OVER (ORDER BY separation DESC, layer))::INT AS rank FROM l")
def report_layer_scan(spark, sf):
    return _layer_report(spark, sf, "two_probe")


def _layer_report(spark, sf, kind: str) -> DataFrame:
    sep = P.separation(kind, F.col("safe"), F.col("danger"), F.col("sp"), F.col("dp"))
    out = probed(spark, sf).select("layer", V.rounded(sep).alias("separation"), V.rounded(V.norm(V.subtract(F.col("safe"), F.col("danger")))).alias("magnitude"))
    return metrics.ranked(out, "separation", "layer")


@query(f"WITH {PROBES}, l AS ({LAYER_SCAN}) SELECT layer, separation FROM l ORDER BY separation DESC, layer LIMIT 1")
def best_layer(spark, sf):
    return metrics.ranked(_layer_report(spark, sf, "two_probe").drop("rank"), "separation", "layer", 1).select("layer", "separation")


@query(f"WITH {PROBES}, l AS ({LAYER_SCAN}) SELECT {r6('max(separation) / 0.004905::DOUBLE')} AS strength_ratio FROM l")
def strength_ratio(spark, sf):
    return _layer_report(spark, sf, "two_probe").agg(V.rounded(F.max("separation") / F.lit(0.004905)).alias("strength_ratio"))
