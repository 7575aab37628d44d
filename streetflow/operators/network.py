"""Road network operators: loading, lookups, degrees, deletions, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from streetflow.functions import geo
from streetflow.plans.cut import dense_index

ENDS = ["begin_node_id", "end_node_id"]


def clip_nodes(nodes: DataFrame, box=geo.CITY_BOX) -> DataFrame:
    """Nodes strictly inside a box; the bounds reach the scan."""
    return nodes.where(geo.in_box(F.col("lat"), F.col("lon"), box))


def keep_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of which both ends are among the nodes."""
    ids = nodes.select("node_id")
    for end in ENDS:
        links = links.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    return links


def number_links(links: DataFrame) -> DataFrame:
    """links with link_id in the order of their ends, from 0.

    Ranks within each begin node, added to the running count of links of smaller begin nodes: no task sees all links.
    """
    per = links.groupBy("begin_node_id").agg(F.count("*").alias("n"))
    buckets = per.withColumn("bucket", F.floor(F.col("begin_node_id") / 1024))
    sums = buckets.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    inside = W.partitionBy("bucket").orderBy("begin_node_id").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, "bucket")
    starts = starts.select("begin_node_id", (F.col("before") + F.col("inside")).alias("start"))
    rank = F.row_number().over(W.partitionBy("begin_node_id").orderBy("end_node_id", "street_length")) - 1
    return links.withColumn("rank", rank).join(starts, "begin_node_id").withColumn(
        "link_id", (F.col("start") + F.col("rank")).cast("long")
    ).drop("rank", "start")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with num_in_links and num_out_links."""
    out = nodes
    for end, name in (("end_node_id", "num_in_links"), ("begin_node_id", "num_out_links")):
        n = links.groupBy(F.col(end).alias("node_id")).agg(F.count("*").alias(name))
        out = out.join(n, "node_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def undirected(links: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes that a link joins."""
    a, b = F.least(*ENDS).alias("a"), F.greatest(*ENDS).alias("b")
    return links.select(a, b).where("a <> b").distinct()


def adjacency(links: DataFrame) -> DataFrame:
    """(i, j, v): symmetric adjacency with a unit self loop per node that occurs."""
    both = links.select(F.col("begin_node_id").alias("i"), F.col("end_node_id").alias("j"))
    both = both.union(both.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return both.union(both.select("i", F.col("i").alias("j"))).distinct().withColumn("v", F.lit(1.0))


def laplacian(adj: DataFrame, normalised: bool = False) -> DataFrame:
    """(i, j, v) of degree minus adjacency, or of the identity minus the scaled adjacency."""
    deg = adj.groupBy("i").agg(F.sum("v").alias("d"))
    if not normalised:
        joined = adj.join(deg, "i")
        return joined.select("i", "j", (F.when(F.col("i") == F.col("j"), F.col("d")).otherwise(0.0) - F.col("v")).alias("v"))
    left = adj.join(deg.withColumnRenamed("d", "di"), "i")
    both = left.join(deg.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    scaled = F.col("v") / F.sqrt(F.col("di") * F.col("dj"))
    return both.select("i", "j", (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - scaled).alias("v"))


def metis_lines(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, line): per node the 1-based numbers of its neighbours, in order."""
    number = dense_index(nodes.select("node_id"), "node_id", "number", start=1)
    und = undirected(links)
    both = und.union(und.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(number.select(F.col("node_id").alias("b"), F.col("number").alias("nb")), "b")
    lists = named.groupBy(F.col("a").alias("node_id")).agg(F.sort_array(F.collect_set("nb")).alias("ns"))
    text = F.coalesce(F.concat_ws(" ", F.col("ns").cast("array<string>")), F.lit(""))
    return nodes.select("node_id").join(lists, "node_id", "left").select("node_id", text.alias("line"))


def last_by_pair(links: DataFrame) -> DataFrame:
    """One link per (begin, end): the one with the largest id."""
    return links.groupBy(*ENDS).agg(F.max("link_id").alias("link_id"), F.max_by("street_length", "link_id").alias("street_length"))


def delete_nodes(nodes: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links without the nodes in gone and what hangs on them; links are numbered anew."""
    left = nodes.join(gone.select("node_id"), "node_id", "left_anti")
    for end in ENDS:
        links = links.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
    return left, number_links(links)


def with_nodes(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """df with the coordinates of both ends of its links."""
    for end, name in (("begin_node_id", "start"), ("end_node_id", "end")):
        at = nodes.select(F.col("node_id").alias(end), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))
        df = df.join(at, end)
    return df


def pace_table(links: DataFrame, nodes: DataFrame, min_trips: int = 0) -> DataFrame:
    """Pace of links that have a time and enough trips, with coordinates."""
    used = links.where((F.col("time") > 0) & (F.col("num_trips") >= min_trips))
    out = with_nodes(used, nodes).withColumn("pace", F.col("time") / F.nullif(F.col("street_length"), F.lit(0.0)))
    return out.select(F.col("begin_node_id").alias("start_node_id"), "end_node_id", "start_lat", "start_lon", "end_lat", "end_lon", "pace", "num_trips")


def adjacent_streets(links: DataFrame, estimated: DataFrame) -> DataFrame:
    """(begin, end, adj_begin, adj_end): links and the estimated ones that share an end with them, in any direction."""
    pairs = None
    for mine in ENDS:
        for other in ENDS:
            e = estimated.select(*(F.col(c).alias(f"adj_{c}") for c in ENDS))
            found = links.select(*ENDS).join(e, F.col(mine) == F.col(f"adj_{other}"))
            pairs = found if pairs is None else pairs.union(found)
    same = (F.col("begin_node_id") == F.col("adj_begin_node_id")) & (F.col("end_node_id") == F.col("adj_end_node_id"))
    return pairs.where(~same).distinct()
