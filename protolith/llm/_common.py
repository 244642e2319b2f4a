"""Session-level helpers that the corpus operators share.

Intermediate tables go to the shared folder that the cluster names in
``spark.checkpoint.dir`` (``protolith.sources.scratch``).
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolith.sources.scratch import work_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a plain scan.

    This cuts lineage: a lost executor costs the tasks that read its part of the
    scan, not the work before it.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pl_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_pl_path", None):
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


#: A key is hot when it holds more than this part of all rows, and at least HOT_ROWS: so there are at most HOT_PARTS of them.
HOT_PARTS, HOT_ROWS = 2000, 256


def hot_keys(counts: DataFrame) -> DataFrame:
    """Of (key, n): the hot keys and into how many parts each is dealt; at most ``HOT_PARTS`` rows by arithmetic."""
    limit = max(HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_PARTS)
    return counts.filter(F.col("n") > limit).select(F.col("key").alias("__hot"), F.ceil(F.col("n") / limit).cast("int").alias("__parts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """Join on ``key``, of which ``right`` has few rows each, with hot keys dealt into parts by a hash of ``spread``.

    The parts' right rows are copied, so no task gets all left rows of a hot key.
    """
    hot = F.broadcast(hot)  # at most HOT_PARTS rows
    parts = F.coalesce("__parts", F.lit(1))
    a = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__hot", "__parts")
    b = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__hot", "__parts")
    return a.join(b, [key, "__part"], how).drop("__part")


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of an id written as text, modulo ``m`` (null for a null id)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)


def uniform(col: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) for each id."""
    h = F.xxhash64(col.cast("string"), F.lit(seed))
    return F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, where PYTHONPATH doesn't already."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(root) in paths or getattr(sc, "_protolith_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="protolith-")) / "protolith.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "protolith").rglob("*")):
            if p.suffix in (".py", ".csv"):
                z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._protolith_shipped = True
