"""Readers, canonical views of the driver's tables, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

LAYERS = 4
LAYER_DIM = 16
DIM = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_any(spark: SparkSession, path: str, format: str = "parquet", schema: str | StructType | None = None, **options) -> DataFrame:
    """A local copy of a data set in any of Spark's formats: parquet, json (a row a line), csv, orc, text."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def text_field(df: DataFrame, col: str, field: str = "text") -> Column:
    """The text of a column that is a string in one source and a struct with ``field`` in another; NULL where neither."""
    kind = df.schema[col].dataType
    if isinstance(kind, StructType):
        return F.col(f"`{col}`.`{field}`").cast("string") if field in kind.fieldNames() else F.lit(None).cast("string")
    return F.col(f"`{col}`").cast("string") if isinstance(kind, StringType) else F.lit(None).cast("string")


def console(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a fixed-width table, whole values."""
    return df._show_string(rows, False, False)


def literal(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A corpus written in code."""
    return spark.createDataFrame(list(rows), schema)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, label (0 safe, 1 dangerous), cat, split, vec: the whole vector of each query."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("query_id"),
        F.when(F.col("label") < 5, 0).otherwise(1).alias("label"),
        F.col("label").alias("cat"),
        F.when(F.col("vec_id") % 10 == 0, "train").otherwise("test").alias("split"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def activations(spark: SparkSession, sf_dir: str, layers: Iterable[int] | None = None, dim: int = LAYER_DIM) -> DataFrame:
    """The vectors, long by layer: layer k is the k-th stretch of ``dim`` components."""
    picked = list(range(DIM // dim)) if layers is None else list(layers)
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.slice("vec", dim * k + 1, dim).alias("vec")) for k in picked]))
    return vectors(spark, sf_dir).withColumn("part", parts).select("query_id", "label", "cat", "split", "part.layer", "part.vec")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, source, label, quality: documents with a toxicity label."""
    d, m = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(m, "doc_id").select(F.col("doc_id").alias("query_id"), "text", "source", F.col("toxic").alias("label"), "quality")


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Adds columns that the source lacks; a NULL in a column that it has stays NULL."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def union_sources(sources: dict[str, Callable[[], DataFrame]], on_error: str = "raise") -> tuple[DataFrame, dict[str, str]]:
    """Unions the sources that can be read; returns what was skipped, by name.

    on_error='skip' reports a source whose read fails and goes on with the rest.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error is 'raise' or 'skip'")
    out, skipped = None, {}
    for name, load in sources.items():
        try:
            df = load()
            df.schema  # noqa: B018  reads the source's metadata
        except Exception as e:
            if on_error == "raise":
                raise
            skipped[name] = str(e).splitlines()[0]
            continue
        df = df.withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no source could be read: {skipped}")
    return out, skipped


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """Reads ``path``, or computes and writes it first; ``refresh`` writes it anew."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if refresh or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def invalidate(spark: SparkSession, *paths: str) -> list[str]:
    """Deletes the listed caches where they exist, and returns those."""
    gone = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True):
            gone.append(path)
    return gone


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """Names and types of the columns."""
    return df.dtypes
