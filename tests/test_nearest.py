"""The broadcast grid of nodes against the joins on cells, and that it moves no point."""

import numpy as np
import pytest

from streetflow.operators import nearest


def tables(spark, n=400):
    r = np.random.default_rng(4)
    # Two tight groups far apart, and nodes that share a place.
    lat = np.r_[40.7 + r.random(n // 2) * 0.001, 40.9 + r.random(n // 2) * 0.05]
    lon = np.r_[-74.0 + r.random(n // 2) * 0.001, -73.9 + r.random(n // 2) * 0.05]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    rows += [(900 + i, a, b) for i, a, b in rows[:50]] + [(-i, a, b) for i, a, b in rows[60:70]] + [(5000, None, -74.0)]
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(40.68 + r.random(300) * 0.3, -74.02 + r.random(300) * 0.2))]
    points += [(1000 + i, a, b) for i, a, b in rows[:100]] + [(3000, None, -74.0), (3002, 10.0, 10.0)]
    return (spark.createDataFrame(points, "trip_id long, lat double, lon double"), spark.createDataFrame(rows, "node_id long, lat double, lon double"))


@pytest.mark.parametrize("together", [nearest.TOGETHER, 40])
def test_the_grid_finds_what_the_joins_find(spark, monkeypatch, together):
    points, nodes = tables(spark)
    monkeypatch.setattr(nearest, "TOGETHER", together)
    for one, two in (
        (nearest.nearest_nodes(points, nodes, "trip_id"), nearest.nearest_by_joins(points, nodes, "trip_id")),
        (nearest.nearest_in_grid(points, nodes, "trip_id", "lat", "lon"), nearest.nearest_in_grid_by_joins(points, nodes, "trip_id", "lat", "lon")),
        (nearest.nearest_in_grid(points, nodes.limit(1), "trip_id", "lat", "lon"), nearest.nearest_in_grid_by_joins(points, nodes.limit(1), "trip_id", "lat", "lon")),
        (nearest.nearest_nodes(points, nodes.limit(0), "trip_id"), nearest.nearest_by_joins(points, nodes.limit(0), "trip_id")),
    ):
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_no_point_is_shuffled(spark):
    points, nodes = tables(spark)
    trips = points.selectExpr("trip_id", "lat as from_lat", "lon as from_lon", "lat as to_lat", "lon as to_lon")
    for df in (nearest.match_trips(trips, nodes), nearest.nearest_in_grid(points, nodes, "trip_id", "lat", "lon")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_many_nodes_go_by_joins(spark, monkeypatch):
    points, nodes = tables(spark)
    trips = points.selectExpr("trip_id", "lat as from_lat", "lon as from_lon", "lat as to_lat", "lon as to_lon")
    want = sorted(map(repr, nearest.match_trips(trips, nodes).select("trip_id", "origin", "dest").collect()))
    monkeypatch.setattr(nearest, "MAX_NODES", 10)
    assert sorted(map(repr, nearest.match_trips(trips, nodes).select("trip_id", "origin", "dest").collect())) == want
