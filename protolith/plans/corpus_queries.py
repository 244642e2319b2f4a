"""Filters, labels, quotas, splits and set operations over ``documents`` and ``labels``."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolith.operators import corpus as C
from protolith.operators import metrics as M
from protolith.plans.registry import query
from protolith.sources import tables as T
from protolith.sources.embedder import HashingEmbedder, embed

#: Categories and their words, in order of precedence.
KEYWORDS = {"insult": ("idiot", "moron", "stupid"), "secret": ("password", "token"), "rights": ("license", "copyright"), "contact": ("phone", "@")}
Q = "q AS (SELECT d.doc_id AS query_id, d.text, d.source, l.toxic AS label, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
STRIPPED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def docs(spark, sf) -> DataFrame:
    return T.read(spark, sf, "documents").withColumnRenamed("doc_id", "query_id")


def has(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("SELECT doc_id AS query_id, length(text) AS n FROM documents")
def text_length(spark, sf):
    return docs(spark, sf).select("query_id", F.char_length("text").cast("long").alias("n"))


@query("SELECT doc_id AS query_id, lower(text) AS low FROM documents")
def text_lower(spark, sf):
    return docs(spark, sf).select("query_id", F.lower("text").alias("low"))


@query("SELECT doc_id AS query_id, contains(lower(text), 'password') AS hit FROM documents")
def text_contains(spark, sf):
    return docs(spark, sf).select("query_id", C.contains_any(F.col("text"), ["password"]).alias("hit"))


@query("SELECT doc_id AS query_id, substr(text, 1, 100) AS preview, substr(text, 1, 80) AS short FROM documents")
def text_preview(spark, sf):
    return docs(spark, sf).select("query_id", F.substring("text", 1, 100).alias("preview"), F.substring("text", 1, 80).alias("short"))


@query("SELECT DISTINCT source, upper(substr(source, 1, 1)) || lower(substr(source, 2)) AS shown FROM documents")
def text_capitalize(spark, sf):
    return docs(spark, sf).select("source").distinct().select("source", F.concat(F.upper(F.left("source", F.lit(1))), F.lower(F.expr("substring(source, 2)"))).alias("shown"))


@query("SELECT doc_id AS query_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 20 AND 2000")
def length_band(spark, sf):
    return C.length_band(docs(spark, sf), 20, 2000, stripped=False).select("query_id", F.char_length("text").cast("long").alias("n"))


@query(f"SELECT doc_id AS query_id, length({STRIPPED}) AS n FROM documents WHERE length({STRIPPED}) BETWEEN 10 AND 200")
def strip_then_length(spark, sf):
    return C.length_band(docs(spark, sf), 10, 200).select("query_id", F.char_length(C.strip(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id AS query_id, CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars >= 5000 THEN 1 END AS label FROM documents WHERE n_chars <= 500 OR n_chars >= 5000")
def label_bands(spark, sf):
    return docs(spark, sf).select("query_id", C.bands(F.col("n_chars"), 500, 5000).alias("label")).filter("label IS NOT NULL")


@query("SELECT doc_id AS query_id, CASE WHEN n_chars / 10000.0::DOUBLE < 0.3 THEN 0 WHEN n_chars / 10000.0::DOUBLE > 0.6 THEN 1 END AS label FROM documents WHERE n_chars / 10000.0::DOUBLE < 0.3 OR n_chars / 10000.0::DOUBLE > 0.6")
def relaxed_band(spark, sf):
    return docs(spark, sf).select("query_id", C.bands(F.col("n_chars") / F.lit(10000.0), 0.3, 0.6, strict=True).alias("label")).filter("label IS NOT NULL")


@query("SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 0 END AS label FROM labels")
def two_rater_label(spark, sf):
    """Both marks as ratings where 1 is danger."""
    m = T.read(spark, sf, "labels")
    return m.select("doc_id", C.two_raters(1 - F.col("quality"), F.col("toxic"), 0, 1).alias("label"))


@query("SELECT doc_id, toxic, 5.0::DOUBLE AS toxicity_ai, CASE WHEN 5.0 >= 5.0 THEN 1 END AS label FROM labels")
def default_when_absent(spark, sf):
    """A rating that the source lacks falls to its default, which is in the dangerous band."""
    m = T.with_defaults(T.read(spark, sf, "labels"), {"toxicity_ai": 5.0, "toxic": 0})
    return m.select("doc_id", "toxic", "toxicity_ai", C.bands(F.col("toxicity_ai"), 1.0, 5.0).alias("label"))


@query(f"WITH {Q} SELECT query_id, source, label FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY query_id) AS rn FROM q) WHERE rn <= 3")
def quota_first_n(spark, sf):
    return C.first_n(T.labelled(spark, sf), 3, ("source", "label"), "query_id").select("query_id", "source", "label")


@query(f"WITH {Q} SELECT query_id, label FROM q ORDER BY query_id LIMIT 300")
def scan_limit(spark, sf):
    """The first rows of a source, by number of rows."""
    return T.labelled(spark, sf).select("query_id", "label").orderBy("query_id").limit(300)


PREFIX = "c AS (SELECT doc_id, toxic, sum((toxic = 0)::INT) OVER w AS safe, sum((toxic = 1)::INT) OVER w AS danger FROM labels WINDOW w AS (ORDER BY doc_id))"


@query(f"WITH {PREFIX} SELECT doc_id, toxic FROM c WHERE doc_id <= coalesce((SELECT min(doc_id) FROM c WHERE safe >= 20 AND danger >= 20), 9223372036854775807)")
def prefix_until_both(spark, sf):
    quotas = {"safe": (F.col("toxic") == 0, 20), "danger": (F.col("toxic") == 1, 20)}
    return C.prefix_until(T.read(spark, sf, "labels"), quotas, "doc_id").select("doc_id", "toxic")


@query(f"WITH {PREFIX} SELECT doc_id, toxic FROM c WHERE doc_id <= coalesce((SELECT min(doc_id) FROM c WHERE danger >= 20), 9223372036854775807)")
def prefix_until_one(spark, sf):
    return C.prefix_until(T.read(spark, sf, "labels"), {"danger": (F.col("toxic") == 1, 20)}, "doc_id").select("doc_id", "toxic")


@query(f"SELECT doc_id AS query_id FROM documents WHERE {has(KEYWORDS['insult'])}")
def keyword_any(spark, sf):
    return docs(spark, sf).filter(C.contains_any(F.col("text"), KEYWORDS["insult"])).select("query_id")


LABELLED_ROWS = " UNION ALL ".join(f"SELECT doc_id AS query_id, '{c}' AS category FROM documents WHERE {has(w)}" for c, w in KEYWORDS.items())
MULTI = f"ml AS ({LABELLED_ROWS} UNION ALL SELECT doc_id, 'general' FROM documents WHERE NOT ({' OR '.join(map(has, KEYWORDS.values()))}))"


def multi(spark, sf) -> DataFrame:
    return C.multi_label(docs(spark, sf), KEYWORDS).select("query_id", "category")


@query(f"WITH {MULTI} SELECT query_id, category FROM ml")
def keyword_multilabel(spark, sf):
    return multi(spark, sf)


FIRST = "CASE " + " ".join(f"WHEN {has(w)} THEN '{c}'" for c, w in KEYWORDS.items()) + " ELSE 'general' END"


@query(f"SELECT doc_id AS query_id, {FIRST} AS category FROM documents")
def first_match_category(spark, sf):
    return docs(spark, sf).select("query_id", C.first_match(F.col("text"), KEYWORDS).alias("category"))


@query(f"SELECT doc_id AS query_id, {has(KEYWORDS['insult'])} AS flagged, CASE WHEN {has(KEYWORDS['insult'])} THEN 'REFUSED' ELSE 'PROCEED' END AS decision FROM documents")
def keyword_classifier(spark, sf):
    flagged = C.contains_any(F.col("text"), KEYWORDS["insult"])
    return docs(spark, sf).select("query_id", flagged.alias("flagged"), F.when(flagged, "REFUSED").otherwise("PROCEED").alias("decision"))


RATINGS = [(1, 0.9, 0.2, 0.9, 0.1), (2, 0.1, 0.2, 0.3, 0.1), (3, None, 0.5, None, 0.4), (4, None, None, None, None), (5, 0.2, 0.31, 0.31, 0.31)]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else str(x) for x in row) + ")" for row in RATINGS)


@query(f"SELECT id::INT AS id, CASE WHEN greatest(a, b, c, d) <= 0.3 THEN 'general' WHEN a = greatest(a, b, c, d) THEN 'threat' WHEN b = greatest(a, b, c, d) THEN 'identity_attack' WHEN c = greatest(a, b, c, d) THEN 'sexual' ELSE 'profanity' END AS category FROM (SELECT id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d FROM (VALUES {_VALUES}) v(id, a, b, c, d))")
def max_score_category(spark, sf):
    names = ("threat", "identity_attack", "sexual", "profanity")
    rows = T.literal(spark, RATINGS, "id int, " + ", ".join(f"{n} double" for n in names))
    return rows.select("id", C.largest({n: F.col(n) for n in names}).alias("category"))


@query(f"WITH {MULTI} SELECT category, count(*) AS n_labels, count(DISTINCT query_id) AS n_rows FROM ml GROUP BY category")
def category_counts(spark, sf):
    return multi(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n_labels"), F.countDistinct("query_id").alias("n_rows"))


@query(f"WITH {MULTI} SELECT category, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS share FROM ml WHERE category <> 'general' GROUP BY category")
def detection_share(spark, sf):
    n = multi(spark, sf).filter("category <> 'general'").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("category", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("share"))  # one row


@query(f"WITH {MULTI} SELECT category, count(*) AS n FROM ml GROUP BY category HAVING count(*) >= 20")
def min_group(spark, sf):
    return multi(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")


@query(f"WITH {MULTI}, n AS (SELECT category, count(*) AS n FROM ml GROUP BY category) SELECT category, n, (row_number() OVER (ORDER BY n DESC, category))::INT AS rank FROM n")
def categories_by_size(spark, sf):
    return M.ranked(multi(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n")), "n", "category")


@query(f"WITH {MULTI} SELECT query_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || query_id), query_id) AS rn FROM ml) WHERE rn <= 10")
def capped_per_category(spark, sf):
    return C.sample(multi(spark, sf), 10, by=("category",))


SPLIT = f"{Q}, tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || query_id), query_id) AS rn FROM q) WHERE rn <= 20)"


def sampled(spark, sf) -> tuple[DataFrame, DataFrame]:
    q = T.labelled(spark, sf)
    return q, C.sample(q, 20, by=("label",))


@query(f"WITH {SPLIT} SELECT query_id, label, 'train' AS split FROM tr UNION ALL SELECT query_id, label, 'test' FROM q WHERE text NOT IN (SELECT text FROM tr)")
def train_test_split(spark, sf):
    return C.train_test(*sampled(spark, sf)).select("query_id", "label", "split")


@query(f"WITH {SPLIT} SELECT query_id, label FROM q WHERE text NOT IN (SELECT text FROM tr)")
def value_anti_join(spark, sf):
    return C.without(*sampled(spark, sf)).select("query_id", "label")


@query("SELECT doc_id AS query_id FROM documents WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def train_test_overlap(spark, sf):
    d = docs(spark, sf)
    return C.overlap(d.filter("query_id % 2 = 1"), d.filter("query_id % 2 = 0")).select("query_id")


LEAST = f"{Q}, n AS (SELECT label, count(*) AS n FROM q GROUP BY label)"


@query(f"WITH {LEAST} SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || query_id)) AS rn FROM q) WHERE rn <= (SELECT min(n) FROM n)")
def balance_downsample(spark, sf):
    return C.balanced(T.labelled(spark, sf), C.shuffled("query_id", 42)).select("query_id", "label")


@query(f"WITH {LEAST} SELECT min(n) AS least FROM n")
def balance_size(spark, sf):
    return T.labelled(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))


@query("SELECT DISTINCT text FROM (SELECT text FROM documents WHERE n_chars < 500 UNION ALL SELECT text FROM documents WHERE coalesce(n_chars >= 300, TRUE) UNION ALL SELECT text FROM benchmark)")
def union_distinct(spark, sf):
    """Two overlapping parts that cover all documents, and the benchmark."""
    d = docs(spark, sf)
    long = F.coalesce(F.col("n_chars") >= 300, F.lit(True))
    return C.union_distinct(d.filter("n_chars < 500").select("text"), d.filter(long).select("text"), T.read(spark, sf, "benchmark").select("text"))


@query(f"WITH {Q} SELECT source, label, count(*) AS n FROM q GROUP BY source, label")
def source_breakdown(spark, sf):
    return T.labelled(spark, sf).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {Q} SELECT count(*) AS total, count(*) FILTER (label = 0) AS safe, count(*) FILTER (label = 1) AS danger FROM q")
def corpus_totals(spark, sf):
    return T.labelled(spark, sf).agg(F.count(F.lit(1)).alias("total"), M.hits(F.col("label") == 0).alias("safe"), M.hits(F.col("label") == 1).alias("danger"))


@query("SELECT DISTINCT source FROM documents")
def distinct_sources(spark, sf):
    return docs(spark, sf).select("source").distinct()


THREE = "s3 AS (SELECT *, floor((row_number() OVER (ORDER BY md5('42:' || query_id), query_id) - 1) / 100)::INT AS part FROM q)"


def three_parts(spark, sf) -> DataFrame:
    """Shuffled into disjoint parts of 100; the three first are used."""
    out = C.first_ranked(T.labelled(spark, sf), 300)
    return out.withColumn("part", F.floor((F.col("__rank") - 1) / 100).cast("int"))


@query(f"WITH {Q}, {THREE} SELECT part, label, count(*) AS n FROM s3 WHERE part < 3 GROUP BY part, label")
def split_balance(spark, sf):
    return three_parts(spark, sf).groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {Q} SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY query_id) AS rn FROM q) WHERE rn <= 25")
def train_prefix(spark, sf):
    """The first half of a training size of 50, by class."""
    return C.first_n(T.labelled(spark, sf), 50 // 2, ("label",), "query_id").select("query_id", "label")


@query(f"WITH {Q}, k AS (SELECT * FROM q WHERE length({STRIPPED}) BETWEEN 20 AND 2000), c AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY query_id) AS rn FROM k) SELECT source, label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM c WHERE rn <= 5 GROUP BY source, label")
def report_corpus(spark, sf):
    """Length band, quota by source and class, then the breakdown, over all documents."""
    kept = C.length_band(C.not_empty(T.labelled(spark, sf)), 20, 2000)
    return C.first_n(kept, 5, ("source", "label"), "query_id").groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


SHARES = {c: " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws) for c, ws in KEYWORDS.items()}
LARGEST = "CASE WHEN greatest({0}) <= 0.3 THEN 'general' {1} END".format(
    ", ".join(f"sh_{c}" for c in KEYWORDS), " ".join(f"WHEN sh_{c} = greatest({', '.join(f'sh_{k}' for k in KEYWORDS)}) THEN '{c}'" for c in KEYWORDS)
)
CAP, SMALLEST, DANGER_QUOTA = 10, 2, 40
MINED = f"""{Q}, c AS (SELECT *, sum((label = 1)::INT) OVER (ORDER BY query_id) AS danger FROM q),
pf AS (SELECT query_id, text, CASE WHEN quality = 0 OR label = 1 THEN 1 WHEN quality = 1 AND label = 0 THEN 0 END AS label FROM c WHERE query_id <= coalesce((SELECT min(query_id) FROM c WHERE danger >= {DANGER_QUOTA}), 9223372036854775807)),
ra AS (SELECT query_id, text, {FIRST} AS category, label FROM pf WHERE label IS NOT NULL),
rs AS (SELECT doc_id AS query_id, text, CASE WHEN n_chars / 10000.0::DOUBLE < 0.3 THEN 0 ELSE 1 END AS label, {", ".join(f"({x})::DOUBLE / {len(KEYWORDS[c])} AS sh_{c}" for c, x in SHARES.items())} FROM documents WHERE n_chars / 10000.0::DOUBLE < 0.3 OR n_chars / 10000.0::DOUBLE > 0.6),
rb AS (SELECT query_id, text, {LARGEST} AS category, label FROM rs),
mn AS (SELECT text, category, label, min(query_id) AS query_id FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY text, category, label),
dg AS (SELECT query_id, category FROM mn WHERE label = 1),
bg AS (SELECT category FROM dg GROUP BY category HAVING count(*) >= {SMALLEST}),
cp AS (SELECT query_id, category, 1 AS label FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || query_id), query_id) AS rn FROM dg WHERE category IN (SELECT category FROM bg)) WHERE rn <= {CAP}),
su AS (SELECT text, min(query_id) AS query_id FROM mn WHERE label = 0 GROUP BY text),
sf AS (SELECT query_id, 'safe' AS category, 0 AS label FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || query_id), query_id) AS rn FROM su) WHERE rn <= (SELECT count(*) FROM cp)),
mined AS (SELECT * FROM cp UNION ALL SELECT * FROM sf)"""


def mined(spark, sf) -> DataFrame:
    """(query_id, category, label): a training set of capped categories and as many safe rows."""
    rows = C.prefix_until(T.labelled(spark, sf), {"danger": (F.col("label") == 1, DANGER_QUOTA)}, "query_id")
    rated = rows.withColumn("label", C.two_raters(1 - F.col("quality"), F.col("label"), 0, 1)).filter("label IS NOT NULL")
    rated = rated.select("query_id", "text", C.first_match(F.col("text"), KEYWORDS).alias("category"), "label")
    low = F.lower("text")
    share = {c: functools.reduce(operator.add, [low.contains(w).cast("int") for w in ws]) / F.lit(float(len(ws))) for c, ws in KEYWORDS.items()}
    banded = docs(spark, sf).withColumn("label", C.bands(F.col("n_chars") / F.lit(10000.0), 0.3, 0.6, strict=True)).filter("label IS NOT NULL")
    banded = banded.select("query_id", "text", C.largest(share).alias("category"), "label")
    # equal texts of both sources are one row; the digest keeps whole texts out of the shuffle
    every = rated.unionByName(banded).withColumn("print", F.sha2("text", 256)).drop("text")
    every = every.groupBy("print", "category", "label").agg(F.min("query_id").alias("query_id"))
    danger = every.filter("label = 1").select("query_id", "category")
    big = danger.groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SMALLEST).select("category")
    capped = C.sample(danger.join(big, "category", "left_semi"), CAP, by=("category",)).select("query_id", "category", F.lit(1).alias("label"))
    size = capped.agg(F.count(F.lit(1)).alias("__n"))
    safe = every.filter("label = 0").groupBy("print").agg(F.min("query_id").alias("query_id"))
    # at most CAP rows of each category, so as many safe rows at most
    matched = C.first_ranked(safe, CAP * (len(KEYWORDS) + 1)).crossJoin(F.broadcast(size)).filter("__rank <= __n")  # one row
    return capped.unionByName(matched.select("query_id", F.lit("safe").alias("category"), F.lit(0).alias("label")))


@query(f"WITH {MINED} SELECT * FROM mined")
def report_category_mining(spark, sf):
    """Two sources (two raters up to a danger quota; relaxed bands), their categories, least size, cap, and as many safe rows."""
    return mined(spark, sf)


# --- the embedder: documents as vectors, so that text categories can have prototypes

#: em: the vectors of labelled documents at the last layer, as HashingEmbedder makes them.
TOKENS = "list_slice(regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+'), 1, 128)"


def embedded_sql(source: str, layers: str = "range(4)") -> str:
    """CTEs up to em (query_id, layer, vec) for the rows (query_id, text) of a source."""
    return f"""et AS (SELECT query_id, {TOKENS} AS w FROM {source}),
eu AS (SELECT query_id, layer, len(w) AS n, unnest(w) AS tok FROM et, {layers} l(layer)),
eh AS (SELECT query_id, layer, n, ('0x' || substr(md5(layer || ':' || tok), 1, 8))::BIGINT AS h FROM eu),
es AS (SELECT query_id, layer, h % 16 AS dim, sum(CASE WHEN (h // 65536) % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE / max(n) AS x FROM eh GROUP BY ALL),
em AS (SELECT query_id, layer, list(coalesce(x, 0::DOUBLE) ORDER BY dim) AS vec FROM (SELECT et.query_id, layer, dim FROM et, {layers} l(layer), range(16) r(dim)) LEFT JOIN es USING (query_id, layer, dim) GROUP BY query_id, layer)"""


@query(f"WITH d AS (SELECT doc_id AS query_id, text FROM documents), {embedded_sql('d')} SELECT query_id, layer::INT AS layer, (i - 1)::INT AS dim, vec[i] AS x FROM em, range(1, 17) r(i)")
def embed_documents_hashing(spark, sf):
    """Every document through the stand-in embedder, all layers from one pass."""
    return embed(docs(spark, sf), HashingEmbedder()).select("query_id", "layer", F.posexplode("vec").alias("dim", "x"))


@query("SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, text FROM benchmark WHERE item_id % 2 = 1 UNION ALL SELECT item_id, NULL FROM benchmark")
def struct_or_string(spark, sf):
    """A prompt that is a string in one source, a struct in another, and neither in a third."""
    b = T.read(spark, sf, "benchmark")
    parts = (
        b.filter("item_id % 2 = 0").select("item_id", F.col("text").alias("prompt")),
        b.filter("item_id % 2 = 1").select("item_id", F.struct("text", F.lit(0.5).alias("toxicity")).alias("prompt")),
        b.select("item_id", F.array("text").alias("prompt")),
    )
    return functools.reduce(DataFrame.unionByName, [p.select("item_id", T.text_field(p, "prompt").alias("text")) for p in parts])
