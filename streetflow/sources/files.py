"""Readers and writers of the text formats, and database tables. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from streetflow.operators import network

# The formats' columns.
NODES = (
    "node_id long, is_complete string, num_in_links int, num_out_links int, osm_traffic_controller string, longitude double, "
    "latitude double, osm_changeset long, birth_timestamp long, death_timestamp long, region_id int"
)
LINKS = (
    "link_id long, begin_node_id long, end_node_id long, begin_angle double, end_angle double, street_length double, "
    "osm_name string, osm_class string, osm_way_id long, startX double, startY double, endX double, endY double, "
    "osm_changeset long, birth_timestamp long, death_timestamp long"
)
SAMPLE_TRIPS = (
    "medallion string, hack_license string, vendor_id string, rate_code int, store_and_fwd_flag string, "
    "pickup_datetime timestamp, dropoff_datetime timestamp, passenger_count int, trip_time_in_secs int, "
    "trip_distance string, pickup_longitude string, pickup_latitude string, dropoff_longitude string, dropoff_latitude string"
)
FARES = "payment_type string, fare_amount double, surcharge double, mta_tax double, tip_amount double, tolls_amount double"
TRIPS = f"{SAMPLE_TRIPS}, {FARES}, pickup_geom string, dropoff_geom string, day_of_week int, hours_of_day int"
LEGACY_TRIPS = f"{SAMPLE_TRIPS}, {FARES}, total_amount double"
SPEEDS = "begin_node_id long, end_node_id long, length double, speed double, time double"
TRAVEL_TIMES = "begin_node_id long, end_node_id long, datetime timestamp, travel_time float, num_trips int"
ARC_FLAGS = "begin_node_id long, end_node_id long, datetime timestamp, arc_flag_forward string, arc_flag_backward string"
FORMATS = {"nodes": NODES, "links": LINKS, "sample_trips": SAMPLE_TRIPS, "trips": TRIPS, "legacy_trips": LEGACY_TRIPS, "speeds": SPEEDS}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A text file with a header, by its fixed schema."""
    return spark.read.schema(FORMATS[kind]).option("header", True).option("enforceSchema", True).csv(path)


def load_map(spark: SparkSession, nodes_path: str, links_path: str, box=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): nodes inside the box, and the links between them, numbered."""
    nodes = read(spark, "nodes", nodes_path).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    # A text that is not empty counts as complete.
    nodes = nodes.withColumn("is_complete", F.length(F.coalesce("is_complete", F.lit(""))) > 0)
    if box is not None:
        nodes = network.clip_nodes(nodes, box)
    links = network.keep_links(read(spark, "links", links_path).drop("link_id"), nodes)
    return nodes, network.number_links(links)


def save_map(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """nodes and links as text with headers, degrees counted anew."""
    out = network.degrees(nodes.drop("num_in_links", "num_out_links"), links)
    out.write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    links.write.mode("overwrite").option("header", True).csv(f"{path}/links")


def save_metis(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """Neighbour lists in node order, the header line first."""
    lines = network.metis_lines(links, nodes)
    head = nodes.agg(F.count("*").alias("n")).crossJoin(network.undirected(links).agg(F.count("*").alias("m")))
    first = head.select(F.lit(None).cast("long").alias("node_id"), F.concat_ws(" ", "n", "m").alias("line"))
    first.unionByName(lines).orderBy(F.col("node_id").asc_nulls_first()).select("line").write.mode("overwrite").text(path)


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table; with a column and its bounds, read in parts at a time."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column is not None:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def write_table(df: DataFrame, url: str, table: str, batch: int = 5000, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()
