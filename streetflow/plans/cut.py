"""Lineage cuts and dense numbering for iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="streetflow-")
        atexit.register(shutil.rmtree, where, True)
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def dense_index(df: DataFrame, key: str, out: str, start: int = 0, width: int = 4096) -> DataFrame:
    """df with the rank of a unique integer key, from start, without gathering all rows in one task.

    Keys are counted per range of ``width``; a row's rank is the count of smaller ranges plus its rank inside its own.
    """
    ranged = df.withColumn("__range", F.floor(F.col(key) / width))
    sums = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(key)) - 1
    return ranged.withColumn("__own", own).join(sums, "__range").withColumn(
        out, (F.col("__own") + F.col("__before") + start).cast("long")
    ).drop("__range", "__own", "__before")


def rounded(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)
