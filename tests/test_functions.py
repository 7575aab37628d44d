"""Hand-made cases of validity, weights and flags."""

import pytest
from pyspark.sql import functions as F

from streetflow.functions import flags, geo
from streetflow.functions import trips as trip

BASE = {"from_lat": 40.75, "from_lon": -73.98, "to_lat": 40.76, "to_lon": -73.97, "mi": 1.0, "s": 300, "at": "2012-03-05 09:00:00"}
CASES = [
    ({}, 0), ({"at": "2010-08-05 09:00:00"}, 23), ({"from_lat": 40.3}, 2), ({"to_lat": 40.75, "to_lon": -73.98}, 5), ({"mi": 0.0005}, 8),
    ({"mi": 21.0}, 10), ({"mi": 0.8}, 13), ({"s": 8}, 17), ({"s": 7300}, 18), ({"mi": 1.2, "s": 11}, 21), ({"mi": 0.9, "s": 7000}, 22),
    ({"to_lat": 40.95, "mi": 14.5, "s": 1500}, 1), ({"mi": 5.0}, 12), ({"s": 30}, 15), ({"s": 4000}, 16), ({"mi": 2.0, "s": 65}, 19),
    ({"mi": 0.9, "s": 3500}, 20),
]


def test_validity(spark):
    rows = [(i, *{**BASE, **c}.values()) for i, (c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, from_lat double, from_lon double, to_lat double, to_lon double, mi double, s long, at string")
    df = df.withColumns(
        {"dist_m": F.col("mi") * geo.MILE, "duration_s": F.col("s"), "pickup_datetime": F.col("at").cast("timestamp_ntz"),
         "straight_line_m": geo.metres(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))}
    )
    got = {r.i: r.c for r in df.select("i", trip.validity().alias("c")).collect()}
    assert got == {i: code for i, (_, code) in enumerate(CASES)}


@pytest.mark.parametrize(
    "scheme, true, guess, want",
    [(("abs", "lasso", 100.0), 200.0, 250.0, 0.5), (("abs", "threshold", 100.0), 200.0, 10.0, 1.0), (("rel", "gauss", 0.5), 1.0, 2.0, 0.018316)],
)
def test_weights(spark, scheme, true, guess, want):
    r = spark.range(1).select(trip.distance_weight(*scheme, F.lit(true), F.lit(guess)).alias("w")).first()
    assert r.w == pytest.approx(want, abs=1e-6)


def test_flags(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1, 1, 0, 1],), ([1, 0, 1, 1, 0, 1],), ([],)], "f array<int>")
    got = df.select("f", flags.to_hex(F.col("f")).alias("h")).withColumn("back", flags.from_hex(F.col("h"), 6)).collect()
    assert [r.h for r in got] == ["6d", "b4", ""]
    assert got[1].back == [1, 0, 1, 1, 0, 1]


def test_raw_features_zero_all_on_bad_numbers(spark):
    names = "trip_distance string, pickup_longitude string, pickup_latitude string, dropoff_longitude string, dropoff_latitude string, duration_s long"
    df = spark.createDataFrame([("1.0", "-73.98", "40.75", "-73.97", "40.76", 300), ("1.0", "", "40.75", "-73.97", "40.76", 300)], names)
    a, b = trip.raw_features(df).collect()
    assert a.dist_m == geo.MILE and a.pace == pytest.approx(300 / geo.MILE)
    assert b.dist_m == 0 and b.pace == 0 and b.straight_line_m == 0 and b.winding == 1
