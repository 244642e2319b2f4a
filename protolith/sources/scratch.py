"""Folders for tables that outlive a task but not a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one that ``spark.checkpoint.dir`` names.

    Where the session names none, a local master (tests, a laptop) gets a temporary
    folder; on a cluster that would be one machine's, so there it is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="protolith-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/protolith/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, for plans that read it in several branches; a lost executor costs a part of the scan only."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
