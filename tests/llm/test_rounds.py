"""A round of training runs its units side by side."""

import numpy as np
from pyspark.sql import functions as F

from streetflow.llm import lm, scratch


def test_the_driver_fetches_one_part(spark, monkeypatch):
    """Parts that the driver fetches one by one are made one by one, so only merged moves may be left to it."""
    df = spark.createDataFrame([(i, False, f"{w} " * 40) for i, w in enumerate("apple bridge castle doctor".split())], "doc_id long, held boolean, text string")
    ranks = lm.read_vocabulary()
    blocks = scratch.stage(lm.make_blocks(df.select("doc_id", "held", F.col("text").cast("binary").alias("data")), ranks), "blocks")
    counts = np.ones(len(ranks) + 1, np.int64)
    units = scratch.stage(lm.unit_windows(blocks, len(ranks), 3), "units").repartition(3)
    fetched, fetch = [], type(units).toLocalIterator
    monkeypatch.setattr(type(units), "toLocalIterator", lambda self, *a: fetched.append(self.rdd.getNumPartitions()) or fetch(self, *a))
    lm.train(units, counts, lm.classes_of(counts)[0])
    assert fetched == [1] * lm.ROUNDS
