"""Tables of slices with their life cycle (travel times, link counts, arc flags), and rows as they are stored.

A table is a folder partitioned by slice. Creating, replacing and deleting touch whole slices; a slice is replaced by
Spark's dynamic partition overwrite, so a failed job leaves the old one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from streetflow.functions import flags as hexflags
from streetflow.sources import store

PAIR = store.PAIR
# Columns of the tables besides the slice.
SCHEMAS = {
    "travel_times": "begin_node_id long, end_node_id long, travel_time double, num_trips long",
    "link_counts": "begin_node_id long, end_node_id long, avg_num_trips double, perc_obs double",
    "arc_flags": "begin_node_id long, end_node_id long, arc_flag_forward string, arc_flag_backward string",
}


class SliceTable:
    """A stored table; kind is one of SCHEMAS."""

    def __init__(self, spark: SparkSession, kind: str, path: str):
        self.spark, self.kind, self.path = spark, kind, path

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        where, fs = self._fs()
        return fs.exists(where)

    def create(self) -> None:
        """An empty folder; an existing table stays as it is."""
        where, fs = self._fs()
        fs.mkdirs(where)

    def drop(self) -> None:
        where, fs = self._fs()
        fs.delete(where, True)

    def size(self) -> int:
        """Bytes of all files."""
        where, fs = self._fs()
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def save(self, rows: DataFrame) -> None:
        """Replace the slices that rows has (a column ``slice`` beside those of the kind)."""
        names = [x.split()[0] for x in SCHEMAS[self.kind].split(", ")]
        store.save(rows.select(*names, "slice"), self.path)

    def load(self, slice_: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{SCHEMAS[self.kind]}, slice string").parquet(self.path)
        return rows if slice_ is None else rows.where(F.col("slice") == slice_)

    def dates(self) -> DataFrame:
        return self.load().select("slice").distinct().orderBy("slice")

    def delete(self, slice_: str) -> None:
        store.delete(self.spark, self.path, slice_)


def arc_flag_rows(flags: DataFrame) -> DataFrame:
    """Rows as stored: hex texts of links that any route needs, and per slice one (0, 0) row that says it is there.

    flags: begin_node_id, end_node_id, slice, forward and backward (array<int> of 0 and 1).
    """
    some = F.exists("forward", lambda x: x == 1) | F.exists("backward", lambda x: x == 1)
    rows = flags.where(some).select(
        *PAIR, "slice", hexflags.to_hex(F.col("forward")).alias("arc_flag_forward"), hexflags.to_hex(F.col("backward")).alias("arc_flag_backward")
    )
    zero = F.lit(0).cast("long")
    head = flags.select("slice").distinct().select(
        zero.alias(PAIR[0]), zero.alias(PAIR[1]), "slice", F.lit("0").alias("arc_flag_forward"), F.lit("0").alias("arc_flag_backward")
    )
    return rows.unionByName(head)


def apply_arc_flags(links: DataFrame, rows: DataFrame, regions: int) -> DataFrame:
    """links with forward and backward (arrays of 0 and 1) of one slice's rows; links without a row have no flag set."""
    found = rows.where("begin_node_id <> 0 or end_node_id <> 0").select(*PAIR, "arc_flag_forward", "arc_flag_backward")
    none = F.array_repeat(F.lit(0), regions)
    out = links.join(found, PAIR, "left")
    for side in ("forward", "backward"):
        text = F.col(f"arc_flag_{side}")
        out = out.withColumn(side, F.when(text.isNull(), none).otherwise(hexflags.from_hex(text, regions)))
    return out.drop("arc_flag_forward", "arc_flag_backward")


def region_flags(links: DataFrame, region_id: int, side: str = "forward") -> DataFrame:
    """(pair, pace): one region's flags in the form of a pace table, 1 where the flag is set and 0 elsewhere."""
    return links.select(*PAIR, F.coalesce(F.get(side, F.lit(region_id)), F.lit(0)).cast("double").alias("pace"))


def speed_rows(links: DataFrame) -> DataFrame:
    """Links in the columns of the speeds format: pair, length, speed, time. Links without a time have neither."""
    speed = F.col("street_length") / F.nullif(F.col("time"), F.lit(0.0))
    return links.where("time > 0").select(*PAIR, F.col("street_length").alias("length"), speed.alias("speed"), F.col("time").cast("double").alias("time"))


def save_speeds(links: DataFrame, path: str) -> None:
    speed_rows(links).write.mode("overwrite").option("header", True).csv(path)


def first_trips(trips: DataFrame, limit: int) -> DataFrame:
    """The first trips by pickup time and id; the limit is the feature."""
    return trips.orderBy("pickup_datetime", "trip_id").limit(limit)


def with_retry(action: Callable, tries: int = 3, wait_s: float = 1.0):
    """What action returns; after an error it is tried again, and the last error is raised."""
    for left in reversed(range(tries)):
        try:
            return action()
        except Exception:
            if not left:
                raise
            time.sleep(wait_s)
