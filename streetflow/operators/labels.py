"""Names and texts of the earlier generation: weighting labels, times by position, and the difference of two paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAIR = ["begin_node_id", "end_node_id"]


def scheme_label(kind: Column, kernel: Column, bandwidth: Column) -> Column:
    """Name of a weighting scheme: kind, kernel and bandwidth; ``none`` without a kernel."""
    return F.when(kernel.isNull(), F.lit("none")).otherwise(F.concat_ws("_", F.upper(kind), F.upper(kernel), bandwidth.cast("long").cast("string")))


def legacy_timestamp(text: Column) -> Column:
    """Timestamp of ``yyyy-mm-dd hh:mm:ss`` by the places of its parts; null if a part is no number."""
    part = lambda a, n: F.substring(text, a, n).try_cast("int")
    return F.try_make_timestamp(part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2).cast("decimal(8,6)"))


def path_difference(links: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """links with tag: 2 on both paths, 5 on the first only, -5 on the second only, 0 on none."""
    x = one.select(*PAIR, F.lit(True).alias("__one")).distinct()
    y = two.select(*PAIR, F.lit(True).alias("__two")).distinct()
    both = links.join(x, PAIR, "left").join(y, PAIR, "left")
    in_one, in_two = F.col("__one").isNotNull(), F.col("__two").isNotNull()
    tag = F.when(in_one & in_two, 2).when(in_one, 5).when(in_two, -5).otherwise(0).cast("long")
    return both.select(*links.columns, tag.alias("tag"))


def compare_paths(one: DataFrame, two: DataFrame, links: DataFrame) -> DataFrame:
    """Per trip: links, seconds and shared links of two paths. one, two: trip_id and pair; links: pair and time."""
    timed = links.select(*PAIR, "time")
    side = lambda df, n: df.join(timed, PAIR).select("trip_id", *PAIR, F.col("time").alias(f"t{n}"))
    both = side(one, 1).join(side(two, 2), ["trip_id", *PAIR], "full")
    return both.groupBy("trip_id").agg(
        F.count("t1").alias("links_one"), F.count("t2").alias("links_two"),
        F.count(F.when(F.col("t1").isNotNull() & F.col("t2").isNotNull(), 1)).alias("shared"),
        F.coalesce(F.sum("t1"), F.lit(0.0)).alias("time_one"), F.coalesce(F.sum("t2"), F.lit(0.0)).alias("time_two"),
    )
