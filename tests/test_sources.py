from pyspark.sql import functions as F

from streetflow.sources import files, store
from streetflow.streaming import hourly

SF = "/root/testdata/sf0.001"


def test_map_round_trip(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text(
        ",".join(x.split()[0] for x in files.NODES.split(", ")) + "\n1,True,0,0,,-73.98,40.75,1,1,1,0\n2,False,0,0,,-73.97,40.76,1,1,1,0\n3,,0,0,,-80.0,40.76,1,1,1,0\n"
    )
    (tmp_path / "links.csv").write_text(
        ",".join(x.split()[0] for x in files.LINKS.split(", ")) + "\n5,2,1,0,0,120.5,A,residential,1,0,0,0,0,1,1,1\n6,1,2,0,0,120.5,A,residential,1,0,0,0,0,1,1,1\n7,1,3,0,0,9,A,residential,1,0,0,0,0,1,1,1\n"
    )
    nodes, links = files.load_map(spark, f"{tmp_path}/nodes.csv", f"{tmp_path}/links.csv", (-74.05, 40.9, -73.85, 40.65))
    assert {(r.node_id, r.is_complete) for r in nodes.collect()} == {(1, True), (2, True)}
    assert {(r.link_id, r.begin_node_id, r.end_node_id) for r in links.collect()} == {(0, 1, 2), (1, 2, 1)}
    files.save_map(nodes, links, f"{tmp_path}/out")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out/nodes")
    assert {(r.node_id, r.num_in_links, r.num_out_links) for r in back.collect()} == {("1", "1", "1"), ("2", "1", "1")}
    files.save_metis(nodes, links, f"{tmp_path}/metis")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/metis").collect()) == ["1", "2", "2 1"]


def test_store_replaces_one_slice(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "a", 10.0, 3), (1, 2, "b", 11.0, 1), (2, 3, "b", 5.0, 0)], "begin_node_id long, end_node_id long, slice string, travel_time double, num_trips long")
    default = rows.select("slice").distinct().withColumn("speed", F.lit(8.0))
    path = f"{tmp_path}/tt"
    store.save(store.travel_time_rows(rows, default), path)
    again = rows.where("slice = 'a'").withColumn("travel_time", F.lit(99.0))
    store.save(store.travel_time_rows(again, default.where("slice = 'a'")), path)
    assert [r.slice for r in store.available(spark, path).collect()] == ["a", "b"]
    links = spark.createDataFrame([(1, 2, 80.0), (2, 3, 80.0)], "begin_node_id long, end_node_id long, street_length double")
    got = {r.begin_node_id: (r.time, r.speed, r.num_trips) for r in store.apply_travel_times(links, store.load(spark, path, "b")).collect()}
    assert got == {1: (11.0, 80 / 11, 1), 2: (10.0, 8.0, 0)}
    store.delete(spark, path, "a")
    assert [r.slice for r in store.available(spark, path).collect()] == ["b"]


def test_stream_equals_batch(spark, tmp_path):
    trips = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").alias("pickup_datetime"))
    for i in range(3):
        trips.where(F.dayofmonth("pickup_datetime").between(1 + 10 * i, 10 + 10 * i)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = hourly.hourly_counts(hourly.read_trips(spark, f"{tmp_path}/in", trips.schema), late="40 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.slice, r.n) for r in spark.table("hours").collect()}
    assert got == {(r.slice, r.n) for r in hourly.hourly_counts(spark.read.parquet(f"{tmp_path}/in")).collect()} and len(got) > 100
    hourly.start(hourly.hourly_counts(hourly.read_trips(spark, f"{tmp_path}/in", trips.schema)), f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    assert spark.read.schema("slice timestamp, n long").parquet(f"{tmp_path}/o").count() >= 0
