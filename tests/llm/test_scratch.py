"""Staged tables leave no shuffle files, and what training has read goes."""

import time

from pyspark.sql import functions as F

from streetflow.llm import lm, scratch


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {x for x in blocks.split() if x.startswith("shuffle_")}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    was = spark.conf.get(scratch.CLEANUP)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = scratch.stage(rows, "rows")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(scratch.CLEANUP) == was
    # Both can be read again.
    assert sorted(out.collect()) == sorted(rows.collect()) and out.count() == 7


def test_the_units_go_after_training(spark, monkeypatch):
    gone, drop = [], scratch.drop
    monkeypatch.setattr(scratch, "drop", lambda x: gone.append(x._scratch_path) or drop(x))
    docs = spark.createDataFrame([(i, f"some words {i} and more") for i in range(20)], "doc_id long, text string")
    assert lm.score_documents(docs, F.col("doc_id") % 7 == 2).count() == 20
    assert [x.split("/")[-1] for x in gone] == ["units"]
