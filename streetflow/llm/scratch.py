"""Intermediate tables in the folder that all executors share, and joins with tables of a checked size.

``spark.checkpoint.dir`` names the folder. Only where that is unset and Spark runs in one process (tests, a laptop) is a
temporary folder made; on a cluster without the setting an error says so, for other machines would not see the files.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a narrow table is broadcast.
SMALL_ROWS = 300_000
#: Spark removes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder for this session's intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/") + "/streetflow"
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="streetflow-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once and read it back: later plans start from the files, so a lost executor costs no recomputation.

    Nothing else can read what the write has shuffled, so those files go at once.
    """
    spark = df.sparkSession
    path, was = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def broadcast_if_small(df: DataFrame, name: str, rows: int = SMALL_ROWS) -> DataFrame:
    """df staged, with the hint to broadcast it if it has at most ``rows`` rows; else left to a shuffled join.

    For tables of a few narrow columns only: the count is what proves the size.
    """
    staged = stage(df, name)
    return F.broadcast(staged) if staged.count() <= rows else staged


def drop(df_or_path: DataFrame | str) -> None:
    """Delete a staged table, best effort, once nothing reads it any more."""
    spark = SparkSession.getActiveSession()
    path = df_or_path if isinstance(df_or_path, str) else getattr(df_or_path, "_scratch_path", None)
    if spark is None or path is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
