"""Snapshots of link times and arc flags as partitioned tables, and trip scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PAIR = ["begin_node_id", "end_node_id"]


def between(trips: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows with first <= column <= last; both bounds reach the scan."""
    kind = trips.schema[column].dataType
    return trips.where(F.col(column).between(F.lit(first).cast(kind), F.lit(last).cast(kind)))


def travel_time_rows(snapshots: DataFrame, default_speed: DataFrame) -> DataFrame:
    """Rows as stored: links with trips, and per slice one (0, 0) row that carries the default speed.

    default_speed: slice, speed.
    """
    head = default_speed.select(
        F.lit(0).cast("long").alias(PAIR[0]), F.lit(0).cast("long").alias(PAIR[1]), "slice",
        F.col("speed").alias("travel_time"), F.lit(0).cast("long").alias("num_trips"),
    )
    rows = snapshots.where("num_trips > 0").select(*PAIR, "slice", "travel_time", F.floor("num_trips").cast("long").alias("num_trips"))
    return rows.unionByName(head)


def save(rows: DataFrame, path: str, key: str = "slice") -> None:
    """Replace the slices that rows has, and no others, in a table partitioned by slice."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def load(spark: SparkSession, path: str, slice_: str | None = None, key: str = "slice") -> DataFrame:
    df = spark.read.option("inferSchema", "false").parquet(path).withColumn(key, F.col(key).cast("string"))
    return df if slice_ is None else df.where(F.col(key) == slice_)


def available(spark: SparkSession, path: str, key: str = "slice") -> DataFrame:
    """Slices of a table, from its partitions."""
    return load(spark, path, key=key).select(key).distinct().orderBy(key)


def delete(spark: SparkSession, path: str, slice_: str, key: str = "slice") -> None:
    """Remove one slice's folder."""
    from urllib.parse import quote

    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={quote(slice_, safe=' -_.')}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(where, True)


def apply_travel_times(links: DataFrame, rows: DataFrame) -> DataFrame:
    """links with time, speed and num_trips of one slice; links without a row get the default speed."""
    head = rows.where("begin_node_id = 0 and end_node_id = 0").select(F.col("travel_time").alias("default_speed")).limit(1)
    found = rows.where("begin_node_id <> 0 or end_node_id <> 0").select(*PAIR, "travel_time", "num_trips")
    out = links.join(found, PAIR, "left").crossJoin(F.broadcast(head))
    time = F.coalesce("travel_time", F.col("street_length") / F.col("default_speed"))
    return out.withColumn("time", time).withColumn("speed", F.col("street_length") / F.nullif(F.col("time"), F.lit(0.0))).withColumn(
        "num_trips", F.coalesce("num_trips", F.lit(0).cast("long"))
    ).drop("travel_time", "default_speed")


def link_counts(snapshots: DataFrame) -> DataFrame:
    """Mean trips per slice of each link, and the share of slices in which it was observed."""
    return snapshots.groupBy(*PAIR).agg(
        F.avg("num_trips").alias("avg_num_trips"), F.avg((F.col("num_trips") > 0).cast("int")).alias("perc_obs")
    )
