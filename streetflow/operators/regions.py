"""Regions of nodes by median splits, and their boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from streetflow.plans.cut import cut

AXES = ("lat", "lon")


def kd_regions(nodes: DataFrame, depth: int, weight: str | None = None) -> DataFrame:
    """(node_id, path, region_id): leaves of a tree of ``depth`` splits, alternately by latitude and longitude.

    A slice is split at the coordinate of its middle row (with weight: of the first row where the running weight reaches
    half the total, by whole division, but never the first row). A node belongs to the leaf that the split values lead
    to: below goes low, equal or above goes high. Regions are numbered by path.
    """
    now, _ = _tree(nodes, depth, weight)
    return now.join(F.broadcast(_numbers(now)), "path").select("node_id", "path", "region_id")


def _numbers(now: DataFrame) -> DataFrame:
    """(path, region_id), at most one row per leaf."""
    return now.select("path").distinct().withColumn("region_id", F.dense_rank().over(W.orderBy("path")).cast("long") - 1)


def _ranked(now: DataFrame, axis: str, weight: bool) -> DataFrame:
    """now with the place of each row in its slice (r), the running weight, half the slice's, and the middle row's place.

    Rows are counted in ``RANGES`` ranges of the axis per slice first, so that no task has to sort a whole slice.
    """
    ends = now.agg(F.min(axis).alias("low"), F.max(axis).alias("high"))
    part = F.floor((F.col(axis) - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)) * RANGES)
    now = now.crossJoin(F.broadcast(ends)).withColumn("part", part).drop("low", "high")
    # RANGES + 1 rows per slice at most.
    sums = now.groupBy("slice", "part").agg(F.count("*").alias("n"), F.sum("w").alias("sum_w"))
    earlier = W.partitionBy("slice").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("slice")
    sums = sums.select(
        "slice", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("sum_w").over(earlier), F.lit(0)).alias("w_before"),
        F.sum("n").over(whole).alias("n_all"), F.floor(F.sum("sum_w").over(whole) / 2).alias("half"),
    )
    own = W.partitionBy("slice", "part").orderBy(axis, "node_id")
    ranked = now.withColumn("own", F.row_number().over(own)).withColumn("own_w", F.sum("w").over(own.rowsBetween(W.unboundedPreceding, 0)))
    ranked = ranked.join(F.broadcast(sums), ["slice", "part"]).withColumn("r", F.col("own") + F.col("n_before") - 1)
    if not weight:
        return ranked.withColumn("mid", F.floor(F.col("n_all") / 2))
    ranked = ranked.withColumn("run", F.col("own_w") + F.col("w_before"))
    middle = ranked.where("run >= half and r > 0").groupBy("slice").agg(F.min("r").alias("mid"))
    return ranked.join(F.broadcast(middle), "slice", "left")


#: Ranges of an axis in which rows are counted before they are ranked.
RANGES = 1024


def _tree(nodes: DataFrame, depth: int, weight: str | None) -> tuple[DataFrame, list[DataFrame]]:
    """(nodes with the path of their leaf, per level the splits: path, split)."""
    now = nodes.select("node_id", "lat", "lon", (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"), F.lit("").alias("slice"), F.lit("").alias("path"))
    levels = []
    for level in range(depth):
        axis = AXES[level % 2]
        # Read by the splits and by three counts of the next level, so it is written once.
        ranked = cut(_ranked(now, axis, weight is not None))
        # One row per slice, at most 2 ** level of them.
        splits = ranked.where("r = mid").select(F.col("slice").alias("path"), F.col(axis).alias("split"))
        levels.append(splits)
        now = ranked.join(F.broadcast(splits), "path", "left").withColumn(
            "path", F.concat("path", F.when(F.col(axis) < F.col("split"), "0").otherwise("1"))
        ).withColumn("slice", F.concat("slice", F.when(F.col("r") < F.col("mid"), "0").otherwise("1")))
        now = now.select("node_id", "lat", "lon", "w", "slice", "path")
    return now, levels


def region_of(points: DataFrame, nodes: DataFrame, depth: int, weight: str | None = None) -> DataFrame:
    """points (with lat and lon) with the path and region_id of the leaf that each lies in; below goes low, equal high.

    region_id is null for a leaf that holds no node.
    """
    now, levels = _tree(nodes, depth, weight)
    out = points.withColumn("path", F.lit(""))
    for level, splits in enumerate(levels):
        turn = F.when(F.col(AXES[level % 2]) < F.col("split"), "0").otherwise("1")
        out = out.join(F.broadcast(splits), "path", "left").withColumn("path", F.concat("path", turn)).drop("split")
    return out.join(F.broadcast(_numbers(now)), "path", "left")


def tree_height(regions: DataFrame) -> DataFrame:
    """(height): depth of the shallowest leaf of kd_regions."""
    return regions.agg(F.min(F.length("path")).cast("long").alias("height"))


def number_boundary(boundary_nodes: DataFrame) -> DataFrame:
    """boundary (node_id, region_id) with the node's number among its region's, in the order of ids, from 0."""
    return boundary_nodes.withColumn("number", F.row_number().over(W.partitionBy("region_id").orderBy("node_id")).cast("long") - 1)


def boundary(links: DataFrame, regions: DataFrame) -> DataFrame:
    """(node_id, region_id) of nodes that a link joins to another region."""
    a = regions.select(F.col("node_id").alias("begin_node_id"), F.col("region_id").alias("ra"))
    b = regions.select(F.col("node_id").alias("end_node_id"), F.col("region_id").alias("rb"))
    crossing = links.join(a, "begin_node_id").join(b, "end_node_id").where("ra <> rb")
    return crossing.select(
        F.explode(
            F.array(
                F.struct(F.col("begin_node_id").alias("node_id"), F.col("ra").alias("region_id")),
                F.struct(F.col("end_node_id").alias("node_id"), F.col("rb").alias("region_id")),
            )
        ).alias("x")
    ).select("x.*").distinct()


def grid_regions(nodes: DataFrame, cells: int = 20) -> DataFrame:
    """(node_id, region_id): cell of a square grid over the extent, by row and column."""
    e = nodes.agg(F.min("lat").alias("s"), (F.max("lat") + 0.01).alias("n"), F.min("lon").alias("w"), (F.max("lon") + 0.01).alias("e"))
    i = F.floor((F.col("lon") - F.col("w")) / (F.col("e") - F.col("w")) * cells)
    j = F.floor((F.col("lat") - F.col("s")) / (F.col("n") - F.col("s")) * cells)
    return nodes.crossJoin(F.broadcast(e)).select("node_id", (i * cells + j).cast("long").alias("region_id"))
