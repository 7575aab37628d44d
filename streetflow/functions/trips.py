"""Trip features and the validity code as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from streetflow.functions import geo

# Validity codes and their bounds, in the order of the tests (miles, seconds, seconds per metre).
ERROR_GPS = (40.4, 41.1, -74.25, -73.5)
BAD_GPS = (40.6, 40.9, -74.05, -73.7)


def winding(dist: Column, line: Column) -> Column:
    return F.when(line <= 0, F.lit(1.0)).otherwise(dist / F.nullif(line, F.lit(0.0)))


def pace(time: Column, dist: Column) -> Column:
    return F.when(dist == 0, F.lit(0.0)).otherwise(time / F.nullif(dist, F.lit(0.0)))


def add_features(trips: DataFrame) -> DataFrame:
    """winding and pace beside the trip columns."""
    return trips.withColumns(
        {
            "winding": winding(F.col("dist_m"), F.col("straight_line_m")),
            "pace": pace(F.col("duration_s"), F.col("dist_m")),
        }
    )


def raw_features(df: DataFrame) -> DataFrame:
    """Typed features of text records: miles to metres; one unparsable number zeroes all five."""
    names = ["trip_distance", "pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude"]
    cast = {c: F.col(c).try_cast("double") for c in names}
    fine = reduce(lambda a, b: a & b, (x.isNotNull() for x in cast.values()))
    parsed = df.withColumns({f"{c}_v": F.when(fine, x).otherwise(0.0) for c, x in cast.items()})
    parsed = parsed.withColumn("dist_m", F.col("trip_distance_v") * geo.MILE)
    line = geo.metres(*(F.col(f"{c}_v") for c in ("pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude")))
    out = parsed.withColumn("straight_line_m", line)
    if "duration_s" not in df.columns:
        out = out.withColumn("duration_s", F.timestamp_diff("SECOND", F.col("pickup_datetime"), F.col("dropoff_datetime")))
    return add_features(out)


def _outside(box, trip: Column) -> Column:
    south, north, west, east = box
    lat = lambda c: (trip[c] < south) | (trip[c] > north)
    lon = lambda c: (trip[c] < west) | (trip[c] > east)
    return lat("from_lat") | lat("to_lat") | lon("from_lon") | lon("to_lon")


def validity() -> Column:
    """0 for a valid trip, else the code of the first test that fails.

    The tests read a struct that is made once a trip: a filter that names the columns would repeat their formulas in each
    test, which Spark then no longer compiles.
    """
    columns = ("from_lat", "from_lon", "to_lat", "to_lon", "straight_line_m", "dist_m", "duration_s")
    made = F.struct(*(F.col(c).alias(c) for c in columns), F.date_format("pickup_datetime", "yyyy-MM").alias("month"))
    return F.get(F.transform(F.array(made), _first_failure), F.lit(0))


def _first_failure(trip: Column) -> Column:
    m, line, dist = geo.MILE, trip["straight_line_m"], trip["dist_m"]
    wind, time, month = winding(dist, line), trip["duration_s"], trip["month"]
    per = pace(time, dist)
    tests = [
        (month.isin("2010-08", "2010-09"), 23),
        (_outside(ERROR_GPS, trip), 2),
        (line < 0.001 * m, 5), (line > 20 * m, 6),
        (dist < 0.001 * m, 8), (dist > 20 * m, 10),
        (wind < 0.95, 13),
        (time < 10, 17), (time > 7200, 18),
        (per < 10 / m, 21), (per > 7200 / m, 22),
        (_outside(BAD_GPS, trip), 1),
        (line > 8 * m, 4), (dist > 15 * m, 8), (wind > 5, 12),
        (time < 60, 15), (time > 3600, 16),
        (per < 40 / m, 19), (per > 3600 / m, 20),
    ]
    out = F
    for test, code in tests:
        out = out.when(test, code)
    return out.otherwise(0)


def distance_weight(kind: str, kernel: str, bandwidth: float, true: Column, estimate: Column) -> Column:
    """Weight of a trip by how far the estimated distance is from the metered one.

    kind: abs or rel error. kernel: gauss, lasso or threshold (signed, so every under-estimate passes).
    """
    error = estimate - true
    if kind == "rel":
        error = error / F.nullif(true, F.lit(0.0))
    scaled = error / bandwidth
    if kernel == "gauss":
        return F.exp(-(scaled * scaled))
    if kernel == "lasso":
        return 1.0 - F.least(F.lit(1.0), F.abs(scaled))
    return (error < bandwidth).cast("int").cast("double")
