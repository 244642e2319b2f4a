"""Composite reports: validation, methods, ensembles, stability, categories, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolith.functions import vectors as V
from protolith.operators import corpus as C
from protolith.operators import ensembles as E
from protolith.operators import metrics as M
from protolith.operators import prototypes as P
from protolith.operators import scoring as S
from protolith.operators import thresholds as T
from protolith.plans.evaluation_queries import (
    BEST_COLS,
    CAT_BEST,
    CLASS,
    CLASSED,
    CONF,
    FAILED,
    GRID,
    MID,
    SMART,
    STEER_SCORES,
    SWEEP,
    VOTES,
    WIDE,
    cat_scored,
    decided,
    flagship_sql,
    layer_report,
    r,
    scored,
    steered,
    train_scored,
)
from protolith.plans import corpus_queries as CQ
from protolith.plans.registry import ACT, PRED, TEST, TRAIN, W, best_of, cos, grid, means, pairs, query, r6, sweep
from protolith.plans.vector_queries import WEIGHTS, mean_pairs
from protolith.plans.vector_queries import test as test_rows
from protolith.plans.vector_queries import train as train_rows
from protolith.sources import tables
from protolith.sources.embedder import HashingEmbedder, embed
from protolith.sources.scratch import stored


@query(f"""WITH {MID} SELECT s.layer, s.label, count(*) AS n, sum(((CASE WHEN score > threshold THEN 0 ELSE 1 END) = s.label)::INT)::BIGINT AS n_correct, {r6('max(threshold)')} AS threshold
FROM sc s JOIN md ON s.layer = md.layer WHERE s.split = 'test' GROUP BY s.layer, s.label""")
def report_validation(spark, sf):
    """The midpoint threshold of the training rows, applied to the test rows."""
    rows = scored(spark, sf).join(T.midpoint(train_scored(spark, sf)), "layer")
    pred = S.predicted(rows, F.col("threshold"))
    out = pred.groupBy("layer", "label").agg(F.count(F.lit(1)).alias("n"), M.hits(F.col("correct")).alias("n_correct"), F.max("threshold").alias("threshold"))
    return out.select("layer", "label", "n", "n_correct", *r("threshold"))


@query(f"""WITH {GRID}, df AS (SELECT layer, avg(((CASE WHEN score > 0 THEN 0 ELSE 1 END) = label)::INT) AS a FROM ts GROUP BY layer)
SELECT df.layer, {r6('df.a')} AS accuracy_default, {r6('bt.accuracy')} AS accuracy_optimized, {r6('bt.t')} AS threshold, {r6('bt.accuracy - df.a')} AS improvement FROM df JOIN bt ON df.layer = bt.layer""")
def report_threshold(spark, sf):
    out = layer_report(scored(spark, sf), mean_pairs(spark, sf)).withColumn("improvement", F.col("accuracy_optimized") - F.col("accuracy_default"))
    return out.select("layer", *r("accuracy_default", "accuracy_optimized", "threshold", "improvement"))


@query(f"WITH {FAILED} SELECT layer, error_type, count(*) AS n, {r6('avg(score)')} AS mean_score, min(query_id) AS first_id FROM fl GROUP BY layer, error_type")
def report_failures(spark, sf):
    f = M.failures(decided(spark, sf))
    return f.groupBy("layer", "error_type").agg(F.count(F.lit(1)).alias("n"), V.rounded(F.avg("score")).alias("mean_score"), F.min("query_id").alias("first_id"))


@query(f"WITH {CLASSED} SELECT cl.layer, cl.cls, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support, {r6('sum(f1 * support) OVER (PARTITION BY cl.layer) / sum(support) OVER (PARTITION BY cl.layer)')} AS weighted_f1 FROM cl")
def report_class_metrics(spark, sf):
    m = M.class_metrics(decided(spark, sf))
    return m.join(M.weighted_f1(m), "layer").select("layer", "cls", "support", *r("precision", "recall", "f1", "weighted_f1"))


@query(f"""WITH {PRED}, b AS (SELECT *, row_number() OVER (PARTITION BY layer, label ORDER BY md5('42:' || query_id), query_id) AS rn FROM pd),
n AS (SELECT layer, min(n) AS least FROM (SELECT layer, label, count(*) AS n FROM pd GROUP BY layer, label) GROUP BY layer)
SELECT b.layer, label, count(*) AS n, {r6('avg(correct::INT)')} AS recall FROM b JOIN n ON b.layer = n.layer WHERE rn <= least GROUP BY b.layer, label""")
def report_balanced_eval(spark, sf):
    """As many rows of each class as the smaller has, layer by layer, then recall by class."""
    pred = decided(spark, sf)
    least = pred.groupBy("layer", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("layer").agg(F.min("n").alias("__most"))
    kept = C.lowest(pred, C.shuffled("query_id", 42), least, ("layer", "label"))
    return kept.groupBy("layer", "label").agg(F.count(F.lit(1)).alias("n"), V.rounded(F.avg(F.col("correct").cast("double"))).alias("recall"))


# --- training sizes: the first n training rows of each class, as a column and not a loop

SIZES = (10, 20)
TRAINED = f"""{ACT}, rk AS (SELECT *, row_number() OVER (PARTITION BY layer, label ORDER BY query_id) AS rn FROM act WHERE split = 'train'),
sz AS (SELECT n::INT AS n_train FROM (VALUES {', '.join(f'({n})' for n in SIZES)}) v(n)),
tn AS (SELECT n_train, layer, label, vec FROM rk, sz WHERE rn <= n_train // 2),
tm AS (SELECT n_train, layer, label, list(m ORDER BY i) AS vec FROM (SELECT n_train, layer, label, i, avg(vec[i]) AS m FROM tn, range(1, 17) r(i) GROUP BY ALL) GROUP BY ALL),
tp AS (SELECT s.n_train, s.layer, s.vec AS safe, d.vec AS danger FROM tm s JOIN tm d ON s.layer = d.layer AND s.n_train = d.n_train WHERE s.label = 0 AND d.label = 1),
ts AS (SELECT p.n_train, a.layer, a.query_id, a.label, {cos('a.vec', 'p.safe')} - {cos('a.vec', 'p.danger')} AS score FROM act a JOIN tp p ON a.layer = p.layer WHERE a.split = 'test'),
{grid('g', *SWEEP)}, {sweep('sw', 'ts', 'g', 'n_train, layer')}, {best_of('bt', 'sw', 'n_train, layer')},
df AS (SELECT n_train, layer, avg(((CASE WHEN score > 0 THEN 0 ELSE 1 END) = label)::INT) AS accuracy_default FROM ts GROUP BY n_train, layer)"""
SIZE_KEYS = ("n_train", "layer")


def size_report(spark, sf) -> DataFrame:
    """(n_train, layer, n, accuracy_default, accuracy_optimized, threshold, separation)."""
    sized = train_rows(spark, sf).withColumn("n_train", F.explode(F.array(*map(F.lit, SIZES))))
    first = F.row_number().over(Window.partitionBy("n_train", "layer", "label").orderBy("query_id"))
    kept = sized.withColumn("rn", first).filter(F.col("rn") <= F.floor(F.col("n_train") / 2))
    protos = P.paired(P.mean_prototypes(kept, SIZE_KEYS), SIZE_KEYS)
    tests = test_rows(spark, sf).withColumn("n_train", F.explode(F.array(*map(F.lit, SIZES))))
    return layer_report(S.score_two(tests, protos, SIZE_KEYS), protos, SIZE_KEYS)


@query(f"WITH {TRAINED} SELECT df.n_train, df.layer, {r6('accuracy_default')} AS accuracy_default, {r6('bt.accuracy')} AS accuracy_optimized, {r6('bt.t')} AS threshold FROM df JOIN bt ON df.n_train = bt.n_train AND df.layer = bt.layer")
def report_train_size(spark, sf):
    return size_report(spark, sf).select("n_train", "layer", *r("accuracy_default", "accuracy_optimized", "threshold"))


#: Stability: each size has weighted prototypes of its first rows, and a random third of the test rows of its own.
STABLE_SIZES = (10, 20, 40)
SPLIT = "(('0x' || substr(md5('42:' || query_id), 1, 8))::BIGINT % 3)::INT"
STABLE = f"""{ACT}, rk AS (SELECT *, row_number() OVER (PARTITION BY layer, label ORDER BY query_id) AS rn FROM act WHERE split = 'train'),
sz AS (SELECT n::INT AS n_train, part::INT AS part FROM (VALUES {', '.join(f'({n}, {k})' for k, n in enumerate(STABLE_SIZES))}) v(n, part)),
tn AS (SELECT n_train, layer, label, vec FROM rk, sz WHERE rn <= n_train // 2),
cm AS (SELECT n_train, layer, label, list(m ORDER BY i) AS vec FROM (SELECT n_train, layer, label, i, avg(vec[i]) AS m FROM tn, range(1, 17) r(i) GROUP BY ALL) GROUP BY ALL),
wt AS (SELECT a.n_train, a.layer, a.label, a.vec, exp(5 * {cos('a.vec', 'c.vec')}) AS raw FROM tn a JOIN cm c ON a.n_train = c.n_train AND a.layer = c.layer AND a.label = c.label),
wm AS (SELECT n_train, layer, label, list(m ORDER BY i) AS vec FROM (SELECT n_train, layer, label, i, sum(raw * vec[i]) / sum(raw) AS m FROM wt, range(1, 17) r(i) GROUP BY ALL) GROUP BY ALL),
tp AS (SELECT s.n_train, s.layer, s.vec AS safe, d.vec AS danger FROM wm s JOIN wm d ON s.layer = d.layer AND s.n_train = d.n_train WHERE s.label = 0 AND d.label = 1),
ts AS (SELECT p.n_train, a.layer, a.query_id, a.label, {cos('a.vec', 'p.safe')} - {cos('a.vec', 'p.danger')} AS score FROM act a JOIN sz ON {SPLIT} = sz.part JOIN tp p ON a.layer = p.layer AND p.n_train = sz.n_train WHERE a.split = 'test'),
{grid('g', *SWEEP)}, {sweep('sw', 'ts', 'g', 'n_train, layer')}, {best_of('bt', 'sw', 'n_train, layer')},
st AS (SELECT layer, var_pop(accuracy) AS variance, {", ".join(f"max(CASE WHEN n_train = {n} THEN accuracy END) AS at_{n}" for n in STABLE_SIZES)} FROM bt GROUP BY layer)"""
FIRST_AT, LAST_AT = f"at_{STABLE_SIZES[0]}", f"at_{STABLE_SIZES[-1]}"


@query(f"WITH {STABLE} SELECT n_train, layer, idx, {r6('t')} AS t, {r6('accuracy')} AS accuracy FROM bt")
def stability_by_size(spark, sf):
    return _by_size(spark, sf).select(*SIZE_KEYS, "idx", *r("t", "accuracy"))


@query(f"WITH {STABLE} SELECT layer, {r6('variance')} AS variance, CASE WHEN {LAST_AT} > {FIRST_AT} + 0.05::DOUBLE THEN 'improving' WHEN {LAST_AT} < {FIRST_AT} - 0.05::DOUBLE THEN 'declining' ELSE 'stable' END AS trend FROM st")
def stability(spark, sf):
    return _stability(spark, sf).select("layer", *r("variance"), "trend")


def _by_size(spark, sf) -> DataFrame:
    """(n_train, layer, idx, t, accuracy): the best threshold of each training size on its own third of the test rows."""
    sized = train_rows(spark, sf).withColumn("n_train", F.explode(F.array(*map(F.lit, STABLE_SIZES))))
    kept = C.first_n(sized, max(STABLE_SIZES) // 2, (*SIZE_KEYS, "label"), "query_id")
    first = F.row_number().over(Window.partitionBy(*SIZE_KEYS, "label").orderBy("query_id"))  # of so many rows
    kept = kept.withColumn("rn", first).filter(F.col("rn") <= F.floor(F.col("n_train") / 2)).drop("rn")
    protos = P.paired(P.weighted_prototypes(kept, SIZE_KEYS), SIZE_KEYS)
    size_of = F.element_at(F.array(*map(F.lit, STABLE_SIZES)), C.hash_part("query_id", 42, len(STABLE_SIZES)) + 1)
    scores = S.score_two(test_rows(spark, sf).withColumn("n_train", size_of), protos, SIZE_KEYS)
    return T.best(T.curve(scores, *SWEEP, keys=SIZE_KEYS), SIZE_KEYS)


def _stability(spark, sf) -> DataFrame:
    at = lambda n: F.max(F.when(F.col("n_train") == n, F.col("accuracy"))).alias(f"at_{n}")
    out = _by_size(spark, sf).groupBy("layer").agg(F.var_pop("accuracy").alias("variance"), *map(at, STABLE_SIZES))
    return out.withColumn("trend", M.trend(F.col(FIRST_AT), F.col(LAST_AT)))


ARROWS = "→".join(["{:.3f}"] * len(STABLE_SIZES)), "→".join(["%.3f"] * len(STABLE_SIZES))


@query(f"WITH {STABLE} SELECT layer, {r6('variance')} AS variance, {r6(FIRST_AT)} AS first, {r6(LAST_AT)} AS last, format('{ARROWS[0]}', {', '.join(f'at_{n}' for n in STABLE_SIZES)}) AS series FROM st")
def report_stability(spark, sf):
    """Accuracy along the training sizes, each on a disjoint split, with its variance."""
    return _stability(spark, sf).select("layer", *r("variance"), V.rounded(F.col(FIRST_AT)).alias("first"), V.rounded(F.col(LAST_AT)).alias("last"), F.format_string(ARROWS[1], *[f"at_{n}" for n in STABLE_SIZES]).alias("series"))


# --- weighted prototypes beside plain ones

WEIGHTED = f"""{WEIGHTS}, {means('wm', 'wt', 'layer, label', weight='raw')}, {pairs('wp', 'wm')}, {pairs('mp', 'cm')},
mt AS (SELECT layer, 'mean' AS method, safe, danger FROM mp UNION ALL SELECT layer, 'weighted', safe, danger FROM wp),
ms AS (SELECT method, a.layer, a.query_id, a.label, {cos('a.vec', 'safe')} - {cos('a.vec', 'danger')} AS score FROM act a JOIN mt ON a.layer = mt.layer WHERE a.split = 'test')"""
METHOD_KEYS = ("method", "layer")


def both_methods(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Prototypes of both methods in one table, and the test scores against them."""
    train = train_rows(spark, sf)
    named = lambda df, n: P.paired(df).withColumn("method", F.lit(n))
    protos = named(P.mean_prototypes(train), "mean").unionByName(named(P.weighted_prototypes(train), "weighted"))
    tests = test_rows(spark, sf).withColumn("method", F.explode(F.array(F.lit("mean"), F.lit("weighted"))))
    return protos, S.score_two(tests, protos, METHOD_KEYS)


@query(f"WITH {WEIGHTED} SELECT method, layer, {r6('avg(((CASE WHEN score > 0 THEN 0 ELSE 1 END) = label)::INT)')} AS accuracy, {r6('avg(score)')} AS mean_score FROM ms GROUP BY method, layer")
def report_weighted_vs_mean(spark, sf):
    _, s = both_methods(spark, sf)
    out = S.predicted(s).groupBy(*METHOD_KEYS).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("score").alias("mean_score"))
    return out.select(*METHOD_KEYS, *r("accuracy", "mean_score"))


@query(f"WITH {WEIGHTED}, {grid('g', *SWEEP)}, {sweep('sw', 'ms', 'g', 'method, layer')}, {best_of('bt', 'sw', 'method, layer')} SELECT method, {BEST_COLS}, (row_number() OVER (PARTITION BY method ORDER BY accuracy DESC, layer))::INT AS rank FROM bt")
def method_comparison(spark, sf):
    _, s = both_methods(spark, sf)
    best = T.best(T.curve(s, *SWEEP, keys=METHOD_KEYS), METHOD_KEYS)
    return M.ranked(best, "accuracy", "layer", by=("method",)).select("method", "layer", "idx", "rank", *r("t", "accuracy"))


#: The test scores against weighted prototypes, in the place of those against plain means.
WEIGHTED_TEST = f"""{WEIGHTS}, {means('wm', 'wt', 'layer, label', weight='raw')}, {pairs('pr', 'wm')},
sc AS (SELECT a.query_id, a.layer, a.label, a.cat, a.split, {cos('a.vec', 'p.safe')} - {cos('a.vec', 'p.danger')} AS score FROM act a JOIN pr p ON a.layer = p.layer), ts AS (SELECT * FROM sc WHERE split = 'test')"""


def weighted(sql: str) -> str:
    return sql.replace(TEST, WEIGHTED_TEST)


def weighted_pairs(spark, sf) -> DataFrame:
    return P.paired(P.weighted_prototypes(train_rows(spark, sf)))


def weighted_scored(spark, sf) -> DataFrame:
    return S.score_two(test_rows(spark, sf), weighted_pairs(spark, sf))


# --- ensembles

ENSEMBLES = f"""{VOTES}, la AS (SELECT layer, avg(correct::INT) AS weight FROM pd GROUP BY layer),
en AS (SELECT pd.query_id, pd.label, sum(pd.score * la.weight) AS score FROM pd JOIN la ON pd.layer = la.layer GROUP BY pd.query_id, pd.label)"""
ENSEMBLE_ROWS = "SELECT 'majority_vote' AS method, avg((prediction = label)::INT) AS a FROM vt UNION ALL SELECT 'weighted', avg(((CASE WHEN score > 0 THEN 0 ELSE 1 END) = label)::INT) FROM en UNION ALL SELECT 'best_single', max(weight) FROM la"


def ensemble_rows(pred: DataFrame) -> DataFrame:
    pred = stored(pred.select("query_id", "layer", "label", "score", "prediction", "correct"), "predictions")  # read by four branches
    one = lambda df, n: df.agg(F.avg(F.col("correct").cast("double")).alias("a")).withColumn("method", F.lit(n))
    weights = E.accuracy_weights(pred)
    votes, summed = E.majority_vote(pred), S.predicted(E.weighted_scores(pred, weights))
    return one(votes, "majority_vote").unionByName(one(summed, "weighted")).unionByName(weights.agg(F.max("weight").alias("a")).withColumn("method", F.lit("best_single")))


@query(weighted(f"WITH {ENSEMBLES}, al AS ({ENSEMBLE_ROWS}) SELECT method, {r6('a')} AS accuracy FROM al"))
def report_ensembles(spark, sf):
    """Votes and weighted scores over layers with weighted prototypes, beside the best layer alone."""
    return ensemble_rows(S.predicted(weighted_scored(spark, sf))).select("method", V.rounded(F.col("a")).alias("accuracy"))


#: The steering scores without the views that the ensembles have already.
STEER_TAIL = STEER_SCORES[STEER_SCORES.index("df AS") :]
STEERED = "SELECT 'steering', max(a) FROM (SELECT layer, avg(((CASE WHEN score > 0 THEN 0 ELSE 1 END) = label)::INT) AS a FROM ss GROUP BY layer)"


@query(f"WITH {ENSEMBLES}, {STEER_TAIL}, al AS ({ENSEMBLE_ROWS} UNION ALL {STEERED}) SELECT method, {r6('a')} AS accuracy, (row_number() OVER (ORDER BY a DESC, method))::INT AS rank FROM al")
def report_methods(spark, sf):
    pred = decided(spark, sf)
    steer = M.accuracy(S.predicted(steered(spark, sf))).agg(F.max("accuracy").alias("a")).withColumn("method", F.lit("steering"))
    every = M.ranked(ensemble_rows(pred).unionByName(steer), "a", "method")
    return every.select("method", "rank", V.rounded(F.col("a")).alias("accuracy"))


SMART_BEST = f"{SMART}, {grid('gw', *WIDE)}, {sweep('se', 'en', 'gw')}, {best_of('be', 'se')}"


@query(weighted(f"WITH {SMART_BEST} SELECT idx, {r6('t')} AS t, {r6('accuracy')} AS accuracy FROM be"))
def report_smart_ensemble(spark, sf):
    """The three layers that do best with weighted prototypes, their scores weighted by accuracy, at the best threshold."""
    s = stored(weighted_scored(spark, sf), "scores")  # read by three branches
    return E.evaluate(E.smart(s, S.predicted(s), T.best(T.curve(s, *SWEEP))), *WIDE).select("idx", *r("t", "accuracy"))


# --- sweeps

@query(weighted(flagship_sql))
def report_all_layers(spark, sf):
    """Every layer's accuracy with weighted prototypes, at 0 and at its best grid threshold, ranked."""
    out = layer_report(weighted_scored(spark, sf), weighted_pairs(spark, sf))
    return M.ranked(out, "accuracy_optimized", "layer").select("layer", "n", "rank", *r("accuracy_default", "accuracy_optimized", "threshold", "separation"))


def layer_subset(n: int) -> list[int]:
    """The layers that a sweep of a large model looks at: both ends, the second ones, and the quarters."""
    return sorted({0, 1, n // 4, n // 2, 3 * n // 4, n - 2, n - 1})


#: A third model stands in by 16 layers of 4 components.
THIRD_DIM = 4
THIRD_LAYERS = layer_subset(tables.DIM // THIRD_DIM)
THIRD = f"""{W}, act AS (SELECT query_id, label, cat, split, l::INT AS layer, list_slice(vec, {THIRD_DIM} * l + 1, {THIRD_DIM} * l + {THIRD_DIM}) AS vec FROM w, (VALUES {', '.join(f'({k})' for k in THIRD_LAYERS)}) v(l)),
cm AS (SELECT layer, label, list(m ORDER BY i) AS vec FROM (SELECT layer, label, i, avg(vec[i]) AS m FROM act, range(1, {THIRD_DIM + 1}) r(i) WHERE {TRAIN} GROUP BY ALL) GROUP BY ALL),
wt AS (SELECT a.layer, a.label, a.vec, exp(5 * {cos('a.vec', 'c.vec')}) AS raw FROM act a JOIN cm c ON a.layer = c.layer AND a.label = c.label WHERE a.split = 'train'),
wm AS (SELECT layer, label, list(m ORDER BY i) AS vec FROM (SELECT layer, label, i, sum(raw * vec[i]) / sum(raw) AS m FROM wt, range(1, {THIRD_DIM + 1}) r(i) GROUP BY ALL) GROUP BY ALL),
{pairs('pr', 'wm')}, ts AS (SELECT a.query_id, a.layer, a.label, {cos('a.vec', 'p.safe')} - {cos('a.vec', 'p.danger')} AS score FROM act a JOIN pr p ON a.layer = p.layer WHERE a.split = 'test')"""


@query(flagship_sql.replace(TEST, THIRD))
def report_third_model(spark, sf):
    """The sweep of a further model over seven of its layers, with weighted prototypes."""
    acts = tables.activations(spark, sf, THIRD_LAYERS, THIRD_DIM)
    protos = P.paired(P.weighted_prototypes(acts.filter("split = 'train'"), dim=THIRD_DIM))
    out = layer_report(S.score_two(acts.filter("split = 'test'"), protos), protos)
    return M.ranked(out, "accuracy_optimized", "layer").select("layer", "n", "rank", *r("accuracy_default", "accuracy_optimized", "threshold", "separation"))


@query(f"WITH {GRID} SELECT layer, printf('%+.6f', round(t, 6)) AS threshold, printf('%5.1f%%', 100 * accuracy) AS percent, printf('%-15s|', 'layer ' || layer) AS name FROM bt")
def number_format(spark, sf):
    """A signed number, a padded share and a name padded to the right."""
    best = T.best(T.curve(scored(spark, sf), *SWEEP))
    return best.select("layer", F.format_string("%+.6f", V.rounded(F.col("t"))).alias("threshold"), F.format_string("%5.1f%%", 100 * F.col("accuracy")).alias("percent"), F.format_string("%-15s|", F.concat(F.lit("layer "), "layer")).alias("name"))


@query(f"""WITH {STEER_SCORES}, sp AS (SELECT layer, min(score) AS lo, max(score) AS hi FROM ss GROUP BY layer),
sw AS (SELECT ss.layer, idx::INT AS idx, CASE WHEN idx = 199 THEN hi ELSE lo + idx * ((hi - lo) / 199) END AS t,
 avg(CASE WHEN (CASE WHEN score > (CASE WHEN idx = 199 THEN hi ELSE lo + idx * ((hi - lo) / 199) END) THEN 0 ELSE 1 END) = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM ss JOIN sp ON ss.layer = sp.layer, range(200) r(idx) GROUP BY ALL),
{best_of('bt', 'sw')}, dz AS (SELECT layer, avg(((CASE WHEN score > 0 THEN 0 ELSE 1 END) = label)::INT) AS a FROM ss GROUP BY layer)
SELECT dz.layer, {r6('dz.a')} AS accuracy_default, {r6('bt.accuracy')} AS accuracy_optimized, {r6('bt.t')} AS threshold FROM dz JOIN bt ON dz.layer = bt.layer""")
def report_steering(spark, sf):
    """Projections have a scale of their own, so the grid spans their range."""
    s = steered(spark, sf)
    best = T.best(T.curve(s, n=200))
    out = M.accuracy(S.predicted(s)).join(best.select("layer", "t", F.col("accuracy").alias("accuracy_optimized")), "layer")
    return out.select("layer", V.rounded(F.col("accuracy")).alias("accuracy_default"), *r("accuracy_optimized"), V.rounded(F.col("t")).alias("threshold"))


CAT_PRED = f"{CAT_BEST}, pd AS (SELECT *, CASE WHEN score > 0 THEN 1 ELSE 0 END AS prediction FROM cb)"


@query(f"WITH {CAT_PRED}, {CLASS.format(conf=CONF, src='pd')} SELECT cl.layer, cls, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support, d.n_detected FROM cl JOIN (SELECT layer, count(detected) AS n_detected FROM pd GROUP BY layer) d ON cl.layer = d.layer")
def report_category(spark, sf):
    pred = S.predicted(cat_scored(spark, sf), higher_is="dangerous")
    seen = pred.groupBy("layer").agg(F.count("detected").alias("n_detected"))
    return M.class_metrics(pred).join(seen, "layer").select("layer", "cls", "support", "n_detected", *r("precision", "recall", "f1"))


# --- categories of texts: keywords name them, the embedder gives the vectors

#: Labelled documents at the embedder's last layer; half of them, by hash, train.
TEXT_HALF = "(('0x' || substr(md5('7:' || q.query_id), 1, 8))::BIGINT % 2)::INT"
TEXT_BASE = f"{CQ.Q}, {CQ.embedded_sql('q', '(VALUES (3))')}"
TEXT_TRAIN = f"""lm AS (SELECT q.query_id, q.text, q.label, em.vec, {TEXT_HALF} AS half FROM q JOIN em ON q.query_id = em.query_id AND em.layer = 3),
ml AS (SELECT query_id, category FROM ({' UNION ALL '.join(f"SELECT query_id, '{c}' AS category FROM lm WHERE {CQ.has(w)}" for c, w in CQ.KEYWORDS.items())} UNION ALL SELECT query_id, 'general' FROM lm WHERE NOT ({' OR '.join(map(CQ.has, CQ.KEYWORDS.values()))}))),
tr AS (SELECT lm.query_id, 1 AS label, ml.category AS cat, lm.vec FROM lm JOIN ml ON lm.query_id = ml.query_id WHERE half = 0 AND label = 1 UNION ALL SELECT query_id, 0, 'safe', vec FROM lm WHERE half = 0 AND label = 0),
te AS (SELECT query_id, label, vec FROM lm WHERE half = 1)"""
#: The same on the mined set: its rows train, labelled documents outside it are tested.
MINED_TRAIN = f"""mv AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id IN (SELECT query_id FROM mined)),
{CQ.embedded_sql('mv', '(VALUES (3))').replace('et AS', 'mt AS').replace('FROM et', 'FROM mt').replace('et.query_id', 'mt.query_id').replace('eu AS', 'mu AS').replace('FROM eu', 'FROM mu').replace('eh AS', 'mh AS').replace('FROM eh', 'FROM mh').replace('es AS', 'ms AS').replace('JOIN es', 'JOIN ms').replace('em AS', 'mm AS')},
tr AS (SELECT mined.query_id, mined.label, mined.category AS cat, mm.vec FROM mined JOIN mm ON mined.query_id = mm.query_id),
te AS (SELECT q.query_id, q.label, em.vec FROM q JOIN em ON q.query_id = em.query_id AND em.layer = 3 WHERE q.query_id NOT IN (SELECT query_id FROM mined))"""
FEWEST = 5
TEXT_SCORED = f"""sv AS (SELECT list(m ORDER BY i) AS vec FROM (SELECT i, avg(vec[i]) AS m FROM tr, range(1, 17) r(i) WHERE label = 0 GROUP BY i)),
ck AS (SELECT cat, list(m ORDER BY i) AS vec FROM (SELECT cat, i, avg(vec[i]) AS m FROM tr, range(1, 17) r(i) WHERE label = 1 GROUP BY cat, i) GROUP BY cat),
cv AS (SELECT ck.cat, (SELECT list(ck.vec[i] - sv.vec[i] ORDER BY i) FROM range(1, 17) r(i)) AS vec FROM ck, sv WHERE ck.cat IN (SELECT cat FROM tr WHERE label = 1 GROUP BY cat HAVING count(*) >= {FEWEST})),
cs AS (SELECT te.query_id, te.label, cv.cat, round({cos('te.vec', 'cv.vec')}, 9) AS score FROM te, cv),
ts AS (SELECT query_id, label, 0 AS layer, score, CASE WHEN score > 0 THEN cat END AS detected FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cat) AS rn FROM cs) WHERE rn = 1),
sp AS (SELECT min(score) AS lo, max(score) AS hi FROM ts),
sw AS (SELECT 0 AS layer, idx::INT AS idx, CASE WHEN idx = 199 THEN hi ELSE lo + idx * ((hi - lo) / 199) END AS t,
 avg(CASE WHEN (CASE WHEN score > (CASE WHEN idx = 199 THEN hi ELSE lo + idx * ((hi - lo) / 199) END) THEN 1 ELSE 0 END) = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM ts, sp, range(200) r(idx) GROUP BY ALL),
{best_of('bt', 'sw')}, df AS (SELECT avg(((CASE WHEN score > 0 THEN 1 ELSE 0 END) = label)::INT) AS accuracy_default FROM ts),
pd AS (SELECT ts.*, CASE WHEN ts.score > bt.t THEN 1 ELSE 0 END AS prediction FROM ts, bt), {CLASS.format(conf=CONF, src='pd')}"""
TEXT_REPORT = f"""SELECT cls, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support, {r6('sum(f1 * support) OVER () / sum(support) OVER ()')} AS weighted_f1,
 {r6('df.accuracy_default')} AS accuracy_default, {r6('bt.accuracy')} AS accuracy_optimized, {r6('bt.t')} AS threshold FROM cl, df, bt"""


def text_vectors(spark, sf) -> DataFrame:
    """query_id, text, label, vec (the embedder's last layer): labelled documents."""
    q = tables.labelled(spark, sf).select("query_id", "text", "label")
    return q.join(embed(q, HashingEmbedder(layers=(3,))).select("query_id", "vec"), "query_id")


def _categorised(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Training rows (a row for each category that a dangerous text has) and test rows."""
    rows = text_vectors(spark, sf).withColumn("half", C.hash_part("query_id", 7, 2)).withColumn("layer", F.lit(0))
    train, test = rows.filter("half = 0"), rows.filter("half = 1")
    danger = C.multi_label(train.filter("label = 1"), CQ.KEYWORDS).withColumnRenamed("category", "cat")
    cols = ("query_id", "label", "layer", "cat", "vec")
    return danger.select(*cols).unionByName(train.filter("label = 0").withColumn("cat", F.lit("safe")).select(*cols)), test.select("query_id", "label", "layer", "vec")


def _mined(spark, sf) -> tuple[DataFrame, DataFrame]:
    picked = CQ.mined(spark, sf)
    d = CQ.docs(spark, sf).join(picked.select("query_id").distinct(), "query_id", "left_semi")
    vec = embed(d, HashingEmbedder(layers=(3,))).select("query_id", "vec")
    train = picked.join(vec, "query_id").select("query_id", "label", F.lit(0).alias("layer"), F.col("category").alias("cat"), "vec")
    test = text_vectors(spark, sf).join(picked.select("query_id").distinct(), "query_id", "left_anti")
    return train, test.select("query_id", "label", F.lit(0).alias("layer"), "vec")


def _text_scored(train: DataFrame, test: DataFrame) -> DataFrame:
    scores = S.category_scores(test, P.category_vectors(train, FEWEST)).withColumn("cat_score", F.round("cat_score", 9))
    best = F.min(F.struct((-F.col("cat_score")).alias("minus"), F.col("cat_seen"))).alias("best")
    out = scores.groupBy("query_id", "label", "layer").agg(best)
    score = -F.col("best.minus")
    return out.select("query_id", "label", "layer", score.alias("score"), F.when(score > 0, F.col("best.cat_seen")).alias("detected"))


def _text_best(s: DataFrame) -> DataFrame:
    return T.best(T.curve(s, n=200, higher_is="dangerous")).select("layer", F.col("t").alias("threshold"), F.col("accuracy").alias("accuracy_optimized"))


def _text_predicted(s: DataFrame) -> DataFrame:
    return S.predicted(s.join(_text_best(s), "layer"), F.col("threshold"), higher_is="dangerous")


def _text_report(s: DataFrame) -> DataFrame:
    m = M.class_metrics(_text_predicted(s))
    default = M.accuracy(S.predicted(s, higher_is="dangerous")).select("layer", F.col("accuracy").alias("accuracy_default"))
    out = m.join(M.weighted_f1(m), "layer").join(default, "layer").join(_text_best(s), "layer")
    return out.select("cls", "support", *r("precision", "recall", "f1", "weighted_f1", "accuracy_default", "accuracy_optimized", "threshold"))


@query(f"WITH {TEXT_BASE}, {TEXT_TRAIN}, {TEXT_SCORED} {TEXT_REPORT}")
def report_text_category(spark, sf):
    """Keyword categories of dangerous texts, a vector for each of enough examples, the best threshold, then metrics by class."""
    return _text_report(_text_scored(*_categorised(spark, sf)))


@query(f"WITH {TEXT_BASE}, {TEXT_TRAIN}, {TEXT_SCORED} SELECT label, count(*) FILTER (prediction = 0) AS pred_0, count(*) FILTER (prediction = 1) AS pred_1 FROM pd GROUP BY label")
def report_text_category_confusion(spark, sf):
    return M.confusion_matrix(_text_predicted(_text_scored(*_categorised(spark, sf)))).drop("layer")


@query(f"WITH {TEXT_BASE}, {TEXT_TRAIN}, {TEXT_SCORED} SELECT detected AS category, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS share, (row_number() OVER (ORDER BY count(*) DESC, detected))::INT AS rank FROM ts WHERE detected IS NOT NULL GROUP BY detected")
def report_text_category_share(spark, sf):
    """How often each category was detected, where any was."""
    n = _text_scored(*_categorised(spark, sf)).filter("detected IS NOT NULL").groupBy(F.col("detected").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return M.ranked(n, "n", "category").crossJoin(F.broadcast(total)).select("category", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("share"), "rank")  # one row


@query(f"WITH {CQ.MINED}, {CQ.embedded_sql('q', '(VALUES (3))')}, {MINED_TRAIN}, {TEXT_SCORED} {TEXT_REPORT}")
def report_mined_category(spark, sf):
    """The same on the mined training set, tested on the labelled documents outside it."""
    return _text_report(_text_scored(*_mined(spark, sf)))


# --- models: three disjoint populations stand in for them

MODELS = f"""{ACT}, mo AS (SELECT *, (query_id % 3)::INT AS model FROM act),
mm AS (SELECT model, layer, label, list(m ORDER BY i) AS vec FROM (SELECT model, layer, label, i, avg(vec[i]) AS m FROM mo, range(1, 17) r(i) WHERE {TRAIN} GROUP BY ALL) GROUP BY ALL),
mp AS (SELECT s.model, s.layer, s.vec AS safe, d.vec AS danger FROM mm s JOIN mm d ON s.layer = d.layer AND s.model = d.model WHERE s.label = 0 AND d.label = 1),
ts AS (SELECT a.model, a.layer, a.query_id, a.label, {cos('a.vec', 'p.safe')} - {cos('a.vec', 'p.danger')} AS score FROM mo a JOIN mp p ON a.layer = p.layer AND a.model = p.model WHERE a.split = 'test'),
{grid('g', *SWEEP)}, {sweep('sw', 'ts', 'g', 'model, layer')}, {best_of('bt', 'sw', 'model, layer')}"""
MODEL_KEYS = ("model", "layer")


def model_best(spark, sf) -> DataFrame:
    model = (F.col("query_id") % 3).cast("int")
    protos = P.paired(P.mean_prototypes(train_rows(spark, sf).withColumn("model", model), MODEL_KEYS), MODEL_KEYS)
    s = S.score_two(test_rows(spark, sf).withColumn("model", model), protos, MODEL_KEYS)
    return T.best(T.curve(s, *SWEEP, keys=MODEL_KEYS), MODEL_KEYS)


@query(f"WITH {MODELS} SELECT model, {BEST_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, layer) AS rn FROM bt) WHERE rn = 1")
def best_per_model(spark, sf):
    return M.ranked(model_best(spark, sf), "accuracy", "layer", 1, ("model",)).select("model", "layer", "idx", *r("t", "accuracy"))


@query(f"WITH {MODELS}, pm AS (SELECT model, layer, accuracy, t FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, layer) AS rn FROM bt) WHERE rn = 1) SELECT model, layer, {r6('accuracy')} AS accuracy, {r6('t')} AS threshold, {r6('max(accuracy) OVER () - accuracy')} AS behind, (row_number() OVER (ORDER BY accuracy DESC, model))::INT AS rank FROM pm")
def report_cross_model(spark, sf):
    """The best layer of every model whose results can be read; those of an earlier run may be missing."""
    earlier = lambda: tables.read(spark, sf, "earlier_model_results").select("model", "layer", "idx", "t", "accuracy")
    every, _ = tables.union_sources({"models": lambda: model_best(spark, sf), "earlier": earlier}, on_error="skip")
    best = M.ranked(every.drop("origin"), "accuracy", "layer", 1, ("model",)).drop("rank")
    top = best.agg(F.max("accuracy").alias("top"))
    out = M.ranked(best, "accuracy", "model").crossJoin(F.broadcast(top))  # one row
    return out.select("model", "layer", "rank", *r("accuracy"), V.rounded(F.col("t")).alias("threshold"), V.rounded(F.col("top") - F.col("accuracy")).alias("behind"))


@query(f"WITH {MODELS} SELECT layer, {', '.join(f'round(max(CASE WHEN model = {k} THEN accuracy END), 6) AS model_{k}' for k in range(3))} FROM bt GROUP BY layer")
def cross_model_comparison(spark, sf):
    at = lambda k: V.rounded(F.max(F.when(F.col("model") == k, F.col("accuracy")))).alias(f"model_{k}")
    return model_best(spark, sf).groupBy("layer").agg(*map(at, range(3)))


# --- fixed values: published results that the overview shows beside computed ones

ACCURACY = [("tone", "gpt2", 38.5), ("tone", "qwen", 50.0), ("content", "gpt2", 92.5), ("content", "qwen", 100.0)]
SEPARATION = [("gpt2", 1, 0.001), ("gpt2", 6, 0.002), ("gpt2", 11, 0.0025), ("gpt2", 18, 0.004), ("gpt2", 23, 0.004905), ("qwen", 1, 0.257812), ("qwen", 18, 0.003), ("qwen", 20, 0.002), ("qwen", 27, 0.023926), ("qwen", 28, 0.010742)]


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)


@query(f"SELECT model, max(CASE WHEN approach = 'tone' THEN accuracy END) AS tone, max(CASE WHEN approach = 'content' THEN accuracy END) AS content, max(CASE WHEN approach = 'content' THEN accuracy END) - max(CASE WHEN approach = 'tone' THEN accuracy END) AS gain FROM (VALUES {values(ACCURACY)}) v(approach, model, accuracy) GROUP BY model")
def published_accuracy(spark, sf):
    """Both approaches of each model, and what the second gains."""
    rows = tables.literal(spark, ACCURACY, "approach string, model string, accuracy double")
    at = lambda a: F.max(F.when(F.col("approach") == a, F.col("accuracy")))
    return rows.groupBy("model").agg(at("tone").alias("tone"), at("content").alias("content"), (at("content") - at("tone")).alias("gain"))


@query(f"WITH s AS (SELECT * FROM (VALUES {values(SEPARATION)}) v(model, layer, separation)) SELECT model, layer::INT AS layer, separation, {r6('separation / (SELECT max(separation) FROM s WHERE model = $$gpt2$$)')} AS strength, (row_number() OVER (PARTITION BY model ORDER BY separation DESC, layer))::INT AS rank FROM s")
def published_layers(spark, sf):
    """Layers by separation, each beside the best of the first model."""
    rows = tables.literal(spark, SEPARATION, "model string, layer int, separation double")
    best = rows.filter("model = 'gpt2'").agg(F.max("separation").alias("best"))
    out = M.ranked(rows, "separation", "layer", by=("model",)).crossJoin(F.broadcast(best))  # one row
    return out.select("model", "layer", "separation", V.rounded(F.col("separation") / F.col("best")).alias("strength"), "rank")
