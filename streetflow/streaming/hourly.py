"""Hourly trip counts over a stream of trip files: the batch counts, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_trips(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_counts(trips: DataFrame, time: str = "pickup_datetime", late: str = "2 hours") -> DataFrame:
    """slice, n: trips per hour; trips later than the watermark are dropped."""
    stamped = trips.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    counts = stamped.groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("slice"), "n")


def start(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished hours, appended to a table; stops when the present files are read."""
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
