"""Scores, decisions, thresholds, metrics and ensembles over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolith.functions import vectors as V
from protolith.operators import ensembles as E
from protolith.operators import metrics as M
from protolith.operators import prototypes as P
from protolith.operators import scoring as S
from protolith.operators import thresholds as T
from protolith.plans.registry import PRED, SCORES, TEST, best_of, cos, grid, query, r6, sweep
from protolith.plans.vector_queries import CATS, STEER, cat_vectors, mean_pairs
from protolith.plans.vector_queries import test as test_rows
from protolith.sources import tables
from protolith.sources.scratch import stored, work_path

SWEEP = (-0.05, 0.05, 200)


def scored(spark, sf) -> DataFrame:
    """Every test row's score by layer."""
    return S.score_two(test_rows(spark, sf), mean_pairs(spark, sf))


def decided(spark, sf) -> DataFrame:
    return S.predicted(scored(spark, sf))


def r(*cols: str):
    return [V.rounded(F.col(c)).alias(c) for c in cols]


@query(f"WITH {TEST} SELECT query_id, layer, label, {r6('score')} AS score FROM ts")
def score_two_proto(spark, sf):
    return scored(spark, sf).select("query_id", "layer", "label", *r("score"))


@query(f"WITH {SCORES} SELECT query_id, layer, label, split, {r6('score')} AS score FROM sc")
def score_long_by_layer(spark, sf):
    return S.score_two(tables.activations(spark, sf), mean_pairs(spark, sf)).select("query_id", "layer", "label", "split", *r("score"))


STEER_SCORES = f"{STEER}, ss AS (SELECT a.query_id, a.layer, a.label, list_inner_product(a.vec, s.steer) AS score FROM act a JOIN st s ON a.layer = s.layer WHERE a.split = 'test')"


def steered(spark, sf) -> DataFrame:
    return S.score_steering(test_rows(spark, sf), P.steering(mean_pairs(spark, sf)))


@query(f"WITH {STEER_SCORES} SELECT query_id, layer, label, {r6('score')} AS score FROM ss")
def score_steering(spark, sf):
    return steered(spark, sf).select("query_id", "layer", "label", *r("score"))


CAT_SCORES = f"{CATS}, cs AS (SELECT a.query_id, a.layer, a.label, c.cat AS cat_seen, {cos('a.vec', 'c.vec')} AS cat_score FROM act a JOIN cv c ON a.layer = c.layer WHERE a.query_id % 2 = 1)"
CAT_BEST = f"{CAT_SCORES}, cb AS (SELECT query_id, layer, label, cat_score AS score, CASE WHEN cat_score > 0 THEN cat_seen END AS detected FROM (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY cat_score DESC, cat_seen) AS rn FROM cs) WHERE rn = 1)"


def cat_test(spark, sf) -> DataFrame:
    return tables.activations(spark, sf).filter("query_id % 2 = 1").select("query_id", "layer", "label", "vec")


def cat_scored(spark, sf) -> DataFrame:
    return S.score_category(cat_test(spark, sf), cat_vectors(spark, sf))


@query(f"WITH {CAT_SCORES} SELECT query_id, layer, label, cat_seen, {r6('cat_score')} AS cat_score FROM cs")
def score_x_categories(spark, sf):
    return S.category_scores(cat_test(spark, sf), cat_vectors(spark, sf)).select("query_id", "layer", "label", "cat_seen", *r("cat_score"))


@query(f"WITH {CAT_BEST} SELECT query_id, layer, label, detected, {r6('score')} AS score FROM cb")
def score_category(spark, sf):
    return cat_scored(spark, sf).select("query_id", "layer", "label", "detected", *r("score"))


@query(f"WITH {TEST} SELECT query_id, layer, CASE WHEN score > 0 THEN 'PROCEED' ELSE 'REFUSED' END AS decision FROM ts")
def decide_named(spark, sf):
    return scored(spark, sf).select("query_id", "layer", S.decide(F.col("score"), names=S.NAMED).alias("decision"))


@query(f"WITH {TEST} SELECT query_id, layer, CASE WHEN score > 0 THEN 'Safe' ELSE 'Dangerous' END AS decision FROM ts")
def decide_class_name(spark, sf):
    return scored(spark, sf).select("query_id", "layer", S.decide(F.col("score"), names=S.CLASSES).alias("decision"))


@query(f"WITH {PRED} SELECT query_id, layer, label, prediction FROM pd")
def decide_int(spark, sf):
    return decided(spark, sf).select("query_id", "layer", "label", "prediction")


@query(f"WITH {CAT_BEST} SELECT query_id, layer, label, CASE WHEN score > 0 THEN 1 ELSE 0 END AS prediction FROM cb")
def decide_reversed(spark, sf):
    return cat_scored(spark, sf).select("query_id", "layer", "label", S.decide(F.col("score"), higher_is="dangerous").alias("prediction"))


@query(f"WITH {PRED} SELECT query_id, layer, correct FROM pd")
def correct_same_domain(spark, sf):
    return decided(spark, sf).select("query_id", "layer", "correct")


@query(f"WITH {TEST} SELECT query_id, layer, CASE WHEN label = 0 THEN score > 0 ELSE NOT score > 0 END AS correct FROM ts")
def correct_cross_domain(spark, sf):
    name = F.when(F.col("label") == 0, "Safe").otherwise("Dangerous")
    return scored(spark, sf).select("query_id", "layer", S.correct_named(name, S.decide(F.col("score"), names=S.NAMED)).alias("correct"))


@query(f"WITH {TEST} SELECT query_id, layer, {r6('abs(score - 0.01::DOUBLE)')} AS confidence FROM ts")
def confidence(spark, sf):
    return scored(spark, sf).select("query_id", "layer", V.rounded(F.abs(F.col("score") - 0.01)).alias("confidence"))


MID = f"{SCORES}, md AS (SELECT layer, (min(CASE WHEN label = 0 THEN score END) + max(CASE WHEN label = 1 THEN score END)) / 2 AS threshold FROM sc WHERE split = 'train' GROUP BY layer)"


def train_scored(spark, sf) -> DataFrame:
    return S.score_two(tables.activations(spark, sf).filter("split = 'train'"), mean_pairs(spark, sf))


@query(f"WITH {MID} SELECT layer, {r6('threshold')} AS threshold FROM md")
def threshold_midpoint(spark, sf):
    return T.midpoint(train_scored(spark, sf)).select("layer", *r("threshold"))


GRID = f"{TEST}, {grid('g', *SWEEP)}, {sweep('sw', 'ts', 'g')}, {best_of('bt', 'sw')}"
BEST_COLS = f"layer, idx, {r6('t')} AS t, {r6('accuracy')} AS accuracy"


@query(f"WITH {GRID} SELECT {BEST_COLS} FROM bt")
def threshold_grid_fixed(spark, sf):
    return T.best(T.curve(scored(spark, sf), *SWEEP)).select("layer", "idx", *r("t", "accuracy"))


def _minmax(margin: str, n: int, test: str) -> str:
    return f"""{TEST}, sp AS (SELECT layer, min(score) - {margin} AS lo, max(score) + {margin} AS hi FROM ts GROUP BY layer),
sw AS (SELECT ts.layer, idx::INT AS idx, CASE WHEN idx = {n - 1} THEN hi ELSE lo + idx * ((hi - lo) / {n - 1}) END AS t,
  avg(CASE WHEN (CASE WHEN {test} THEN 1 ELSE 0 END) = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
  FROM ts JOIN sp ON ts.layer = sp.layer, range({n}) r(idx) GROUP BY ALL), {best_of('bt', 'sw')}"""


_T = "(CASE WHEN idx = {m} THEN hi ELSE lo + idx * ((hi - lo) / {m}) END)"


@query(f"WITH {_minmax('0.01::DOUBLE', 200, 'score <= ' + _T.format(m=199))} SELECT {BEST_COLS} FROM bt")
def threshold_grid_minmax(spark, sf):
    return T.best(T.curve(scored(spark, sf), n=200, margin=0.01)).select("layer", "idx", *r("t", "accuracy"))


@query(f"WITH {_minmax('0::DOUBLE', 100, 'score < ' + _T.format(m=99))} SELECT {BEST_COLS} FROM bt")
def threshold_grid_readme(spark, sf):
    return T.best(T.curve(scored(spark, sf), n=100, strict_below=True)).select("layer", "idx", *r("t", "accuracy"))


@query(f"WITH {GRID} SELECT {BEST_COLS} FROM sw")
def accuracy_curve(spark, sf):
    return T.curve(scored(spark, sf), *SWEEP).select("layer", "idx", *r("t", "accuracy"))


@query(f"WITH {TEST}, {grid('g', -0.02, 0.02, 100)} SELECT layer, idx, {r6('t')} AS t, sum(CASE WHEN (CASE WHEN score > t THEN 0 ELSE 1 END) = label THEN 1 ELSE 0 END)::BIGINT AS n_correct FROM ts, g GROUP BY layer, idx, t")
def score_x_grid(spark, sf):
    points = T.product(scored(spark, sf), V.linspace(spark, -0.02, 0.02, 100))
    return points.groupBy("layer", "idx", "t").agg(M.hits(F.col("correct")).alias("n_correct")).select("layer", "idx", "n_correct", *r("t"))


@query(f"WITH {PRED} SELECT layer, {r6('avg(correct::INT)')} AS accuracy, count(*) AS n FROM pd GROUP BY layer")
def accuracy(spark, sf):
    return M.accuracy(decided(spark, sf)).select("layer", "n", *r("accuracy"))


two_proto_eval_sql = f"WITH {PRED} SELECT layer, {r6('avg(correct::INT)')} AS accuracy, {r6('avg(score)')} AS mean_score, count(*) AS n FROM pd GROUP BY layer"


@query(two_proto_eval_sql)
def two_proto_eval(spark, sf):
    out = decided(spark, sf).groupBy("layer").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    return out.select("layer", "n", *r("accuracy", "mean_score"))


@query(f"WITH {STEER_SCORES} SELECT layer, {r6('avg(((CASE WHEN score > 0 THEN 0 ELSE 1 END) = label)::INT)')} AS accuracy, count(*) AS n FROM ss GROUP BY layer")
def steering_eval(spark, sf):
    return M.accuracy(S.predicted(steered(spark, sf))).select("layer", "n", *r("accuracy"))


@query(f"WITH {CAT_BEST} SELECT layer, {r6('avg(((CASE WHEN score > 0 THEN 1 ELSE 0 END) = label)::INT)')} AS accuracy, count(*) AS n FROM cb GROUP BY layer")
def category_eval(spark, sf):
    return M.accuracy(S.predicted(cat_scored(spark, sf), higher_is="dangerous")).select("layer", "n", *r("accuracy"))


@query(f"WITH {PRED} SELECT layer, label, count(*) AS n, sum(correct::INT)::BIGINT AS n_correct, {r6('avg(correct::INT)')} AS recall FROM pd GROUP BY layer, label")
def per_class_recall(spark, sf):
    return M.per_class(decided(spark, sf)).select("layer", "label", "n", "n_correct", *r("recall"))


CONF = "count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp"
CLASS = """cf AS (SELECT layer, {conf} FROM {src} GROUP BY layer), cm2 AS (
  SELECT layer, 0 AS cls, tn AS a, fn AS wrong, fp AS missed FROM cf UNION ALL SELECT layer, 1, tp, fp, fn FROM cf),
cl AS (SELECT layer, cls, coalesce(a / nullif(a + wrong, 0), 0)::DOUBLE AS precision, coalesce(a / nullif(a + missed, 0), 0)::DOUBLE AS recall,
  coalesce(2 * a / nullif(2 * a + wrong + missed, 0), 0)::DOUBLE AS f1, a + missed AS support FROM cm2)"""
CLASSED = f"{PRED}, {CLASS.format(conf=CONF, src='pd')}"


@query(f"WITH {CLASSED} SELECT layer, cls, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support FROM cl")
def class_metrics(spark, sf):
    return M.class_metrics(decided(spark, sf)).select("layer", "cls", "support", *r("precision", "recall", "f1"))


@query(f"WITH {CLASSED} SELECT layer, {r6('f1')} AS f1 FROM cl WHERE cls = 1")
def binary_f1(spark, sf):
    return M.class_metrics(decided(spark, sf)).filter("cls = 1").select("layer", *r("f1"))


@query(f"WITH {CLASSED} SELECT layer, {r6('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM cl GROUP BY layer")
def weighted_f1(spark, sf):
    return M.weighted_f1(M.class_metrics(decided(spark, sf))).select("layer", *r("weighted_f1"))


@query(f"WITH {PRED} SELECT layer, label, count(*) FILTER (prediction = 0) AS pred_0, count(*) FILTER (prediction = 1) AS pred_1 FROM pd GROUP BY layer, label")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(decided(spark, sf))


@query(f"WITH {PRED} SELECT query_id, layer, label, {r6('score')} AS score, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS error_type FROM pd WHERE NOT correct")
def failures(spark, sf):
    return M.failures(decided(spark, sf)).select("query_id", "layer", "label", "error_type", *r("score"))


FAILED = f"{PRED}, fl AS (SELECT *, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS error_type FROM pd WHERE NOT correct)"


@query(f"WITH {FAILED} SELECT layer, error_type, query_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY layer, error_type ORDER BY query_id))::INT AS rank FROM fl) WHERE rank <= 3")
def failure_examples(spark, sf):
    return M.first_examples(M.failures(decided(spark, sf)), 3, ("layer", "error_type"), "query_id").select("layer", "error_type", "query_id", "rank")


VOTES = f"{PRED}, vt AS (SELECT query_id, label, sum(prediction)::BIGINT AS votes, CASE WHEN sum(prediction) > count(*) / 2 THEN 1 ELSE 0 END AS prediction FROM pd GROUP BY query_id, label)"


@query(f"WITH {VOTES} SELECT query_id, label, votes, prediction FROM vt")
def majority_vote(spark, sf):
    return E.majority_vote(decided(spark, sf)).select("query_id", "label", "votes", "prediction")


ENS = f"{PRED}, la AS (SELECT layer, avg(correct::INT) AS weight FROM pd GROUP BY layer), en AS (SELECT pd.query_id, pd.label, 0 AS layer, sum(pd.score * la.weight) AS score FROM pd JOIN la ON pd.layer = la.layer GROUP BY pd.query_id, pd.label)"


@query(f"WITH {ENS} SELECT query_id, label, {r6('score')} AS score, CASE WHEN score > 0 THEN 0 ELSE 1 END AS prediction FROM en")
def weighted_ensemble(spark, sf):
    pred = decided(spark, sf)
    return S.predicted(E.weighted_scores(pred, E.accuracy_weights(pred))).select("query_id", "label", "prediction", *r("score"))


SMART = f"""{GRID}, pd AS (SELECT *, (CASE WHEN score > 0 THEN 0 ELSE 1 END) = label AS correct FROM ts),
la AS (SELECT layer, avg(correct::INT) AS weight FROM pd GROUP BY layer), tk AS (SELECT layer FROM bt ORDER BY accuracy DESC, layer LIMIT 3),
en AS (SELECT pd.query_id, pd.label, 0 AS layer, sum(pd.score * la.weight) AS score FROM pd JOIN la ON pd.layer = la.layer WHERE pd.layer IN (SELECT layer FROM tk) GROUP BY pd.query_id, pd.label)"""
#: Ensemble scores are sums of layers' scores, so their grid is wider.
WIDE = (-0.15, 0.15, 200)


def smart_scores(spark, sf) -> DataFrame:
    s = stored(scored(spark, sf), "scores")  # read by three branches
    return E.smart(s, S.predicted(s), T.best(T.curve(s, *SWEEP)))


@query(f"WITH {SMART} SELECT query_id, label, {r6('score')} AS score FROM en")
def smart_ensemble(spark, sf):
    return smart_scores(spark, sf).select("query_id", "label", *r("score"))


@query(f"WITH {GRID} SELECT layer, {r6('accuracy')} AS accuracy, rank FROM (SELECT *, (row_number() OVER (ORDER BY accuracy DESC, layer))::INT AS rank FROM bt) WHERE rank <= 3")
def top_layers(spark, sf):
    return M.ranked(T.best(T.curve(scored(spark, sf), *SWEEP)), "accuracy", "layer", 3).select("layer", "rank", *r("accuracy"))


@query(f"WITH {GRID} SELECT {BEST_COLS}, (row_number() OVER (ORDER BY accuracy DESC, layer))::INT AS rank FROM bt")
def ranked_layers(spark, sf):
    return M.ranked(T.best(T.curve(scored(spark, sf), *SWEEP)), "accuracy", "layer").select("layer", "idx", "rank", *r("t", "accuracy"))


flagship_sql = f"""WITH {GRID}, df AS (SELECT layer, avg(((CASE WHEN score > 0 THEN 0 ELSE 1 END) = label)::INT) AS accuracy_default, count(*) AS n FROM ts GROUP BY layer)
SELECT bt.layer, df.n, {r6('accuracy_default')} AS accuracy_default, {r6('bt.accuracy')} AS accuracy_optimized, {r6('bt.t')} AS threshold, {r6('1 - ' + cos('pr.safe', 'pr.danger'))} AS separation,
  (row_number() OVER (ORDER BY bt.accuracy DESC, bt.layer))::INT AS rank FROM bt JOIN df ON bt.layer = df.layer JOIN pr ON pr.layer = bt.layer"""


def layer_report(s: DataFrame, pairs: DataFrame, keys=("layer",), grid_=SWEEP) -> DataFrame:
    """(keys, n, accuracy_default, accuracy_optimized, threshold, separation)."""
    default = M.accuracy(S.predicted(s), keys).withColumnRenamed("accuracy", "accuracy_default")
    best = T.best(T.curve(s, *grid_, keys=keys), keys).select(*keys, F.col("t").alias("threshold"), F.col("accuracy").alias("accuracy_optimized"))
    sep = pairs.select(*keys, P.separation("one_minus_cos", F.col("safe"), F.col("danger")).alias("separation"))
    return default.join(best, list(keys)).join(sep, list(keys))


@query(flagship_sql)
def flagship_layer_sweep(spark, sf):
    """Every layer's accuracy at 0 and at its best grid threshold, ranked."""
    out = layer_report(scored(spark, sf), mean_pairs(spark, sf))
    return M.ranked(out, "accuracy_optimized", "layer").select("layer", "n", "rank", *r("accuracy_default", "accuracy_optimized", "threshold", "separation"))


@query(f"""WITH {TEST}, sp AS (SELECT layer, min(score) AS lo, max(score) AS hi FROM ts GROUP BY layer)
SELECT ts.layer, label, least(49, floor((score - lo) / ((hi - lo) / 50)))::INT AS bin, count(*) AS n FROM ts JOIN sp ON ts.layer = sp.layer GROUP BY ALL""")
def score_histogram(spark, sf):
    return M.histogram(scored(spark, sf))


@query(f"WITH {TEST} SELECT layer, label, count(*) AS n, {r6('avg(score)')} AS mean_score, {r6('min(score)')} AS min_score, {r6('max(score)')} AS max_score, {r6('var_pop(score)')} AS variance FROM ts GROUP BY layer, label")
def report_distribution(spark, sf):
    out = scored(spark, sf).groupBy("layer", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.var_pop("score").alias("variance"))
    return out.select("layer", "label", "n", *r("mean_score", "min_score", "max_score", "variance"))


@query(f"WITH {TEST} SELECT query_id, CASE WHEN score > 0 THEN 'PROCEED' ELSE 'REFUSED' END AS decision, {r6('score')} AS difference FROM ts WHERE layer = 0")
def monitor_check(spark, sf):
    out = S.Monitor(mean_pairs(spark, sf)).score(test_rows(spark, sf).filter("layer = 0"))
    return out.select("query_id", "decision", *r("difference"))


@query(f"WITH {TEST} SELECT query_id, score > 0.01::DOUBLE AS safe, {r6('score')} AS difference, {r6('abs(score - 0.01::DOUBLE)')} AS confidence FROM ts WHERE layer = 3")
def monitor_confidence(spark, sf):
    out = S.Monitor(mean_pairs(spark, sf), layer=3, threshold=0.01).score(test_rows(spark, sf).filter("layer = 3"))
    return out.select("query_id", "safe", *r("difference", "confidence"))


@query(f"WITH {GRID}, df AS (SELECT layer, avg(((CASE WHEN score > 0 THEN 0 ELSE 1 END) = label)::INT) AS a FROM ts GROUP BY layer) SELECT df.layer, {r6('bt.accuracy - df.a')} AS improvement FROM df JOIN bt ON df.layer = bt.layer")
def improvement_delta(spark, sf):
    out = layer_report(scored(spark, sf), mean_pairs(spark, sf))
    return out.select("layer", V.rounded(F.col("accuracy_optimized") - F.col("accuracy_default")).alias("improvement"))


@query(f"WITH {PRED} SELECT layer, round(100 * avg(correct::INT), 1) AS percent, (sum(correct::INT))::VARCHAR || '/' || count(*) AS shown FROM pd GROUP BY layer")
def percent_format(spark, sf):
    out = decided(spark, sf).groupBy("layer").agg(M.hits(F.col("correct")).alias("k"), F.count(F.lit(1)).alias("n"))
    return out.select("layer", F.round(100 * F.col("k") / F.col("n"), 1).alias("percent"), F.concat_ws("/", "k", "n").alias("shown"))


@query(f"WITH {PRED}, a AS (SELECT layer, avg(correct::INT) AS accuracy FROM pd GROUP BY layer) SELECT {r6('max(accuracy)')} AS max_accuracy, {r6('min(accuracy)')} AS min_accuracy FROM a")
def report_max(spark, sf):
    return M.accuracy(decided(spark, sf)).agg(V.rounded(F.max("accuracy")).alias("max_accuracy"), V.rounded(F.min("accuracy")).alias("min_accuracy"))


@query(f"WITH {PRED}, a AS (SELECT layer, avg(correct::INT) AS accuracy FROM pd GROUP BY layer) SELECT string_agg(format('{{:.3f}}', accuracy), '→' ORDER BY layer) AS series FROM a")
def series_concat(spark, sf):
    a = M.accuracy(decided(spark, sf)).agg(F.array_sort(F.collect_list(F.struct("layer", "accuracy"))).alias("all"))  # a row for each layer
    return a.select(F.concat_ws("→", F.transform("all", lambda x: F.format_string("%.3f", x["accuracy"]))).alias("series"))


# --- results on disk

RESULT = "query_id bigint, layer int, label int, prediction int, score double, correct boolean"


def results(spark, sf) -> DataFrame:
    return decided(spark, sf).select("query_id", "layer", "label", "prediction", *r("score"), "correct")


@query(f"WITH {PRED} SELECT query_id, layer, label, prediction, {r6('score')} AS score, correct FROM pd")
def results_through_csv(spark, sf):
    """The result rows as a CSV file with a header, read with a schema."""
    path = work_path(spark, "results")
    tables.write_csv(results(spark, sf), path)
    return tables.read_csv(spark, path, RESULT)


@query(f"WITH {PRED} SELECT layer, {r6('avg(correct::INT)')} AS accuracy FROM pd GROUP BY layer")
def results_through_cache(spark, sf):
    """Computed and written once, read after that, thrown away, and computed anew."""
    path = work_path(spark, "cache")
    tables.cached(spark, path, lambda: results(spark, sf))
    tables.invalidate(spark, path)
    return M.accuracy(tables.cached(spark, path, lambda: results(spark, sf))).select("layer", *r("accuracy"))


@query("SELECT 'documents' AS origin, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark")
def sources_that_can_be_read(spark, sf):
    """A union of three sources, of which one is missing and is passed over."""
    one = lambda name, key: lambda: tables.read(spark, sf, name).select(F.col(key).alias("id"), "text")
    found, _ = tables.union_sources({"documents": one("documents", "doc_id"), "absent": one("absent", "id"), "benchmark": one("benchmark", "item_id")}, on_error="skip")
    return found.select("origin", "id", F.char_length("text").cast("long").alias("n"))


@query("SELECT column_name AS name, CASE data_type WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS kind FROM (DESCRIBE documents) d(column_name, data_type, a, b, c, d)")
def schema_listing(spark, sf):
    return tables.literal(spark, tables.describe(tables.read(spark, sf, "documents")), "name string, kind string")
