"""The searches in Java give the paths and costs of those in Python."""

import random

import numpy as np
import pytest

from streetflow.operators import kernels, native, routing
from tests.test_flags_and_pieces import sparse
from tests.test_graph import lattice

def plain(g):
    """g without a helper."""
    return kernels.Graph(*g.raw()[:-1], b"")


@pytest.fixture(autouse=True)
def few(monkeypatch):
    monkeypatch.setattr(kernels, "FEW", 1)


@pytest.mark.parametrize("make", [lattice, sparse, lambda: sparse(300, 700, 8), lambda: sparse(120, 400, 7, True)])
def test_paths_and_costs_equal_those_in_python(spark, make):
    g, region = make()
    r = random.Random(4)
    trips = [(r.randrange(-1, len(g.ids)), r.randrange(-1, len(g.ids))) for _ in range(400)] + [(i, 5) for i in range(100)] + [(3, 3)]
    s, t = (np.array(x) for x in zip(*trips))
    f, b = kernels.arc_flags(g, g.time.tolist(), region, sorted(set(region.tolist())))
    for speed in [None] + [g.max_speed(g.time)] * (g.y is not None):
        for flags in (None, (f, b, region)):
            for alike in (None, t == 5) if flags is None and speed is None else (None,):
                one, two = (kernels.search(x, s, t, g.time, speed, flags, alike) for x in (g, plain(g)))
                assert g.router is not None
                for x, y in zip(one, two):
                    assert np.array_equal(x, y, equal_nan=x.dtype.kind == "f")
    # Other times are taken over.
    other = g.time * np.random.default_rng(1).uniform(0.5, 2, len(g.time))
    assert np.array_equal(kernels.search(g, s, t, other)[2], kernels.search(plain(g), s, t, other)[2])


def test_estimates_equal_those_in_python(spark):
    g, _ = lattice()
    r = random.Random(2)
    pairs = [(r.randrange(144), r.randrange(144)) for _ in range(80)]
    trips = kernels.Observed([a for a, _ in pairs], [b for _, b in pairs], [500] * 80, [[r.uniform(30, 200)] for _ in pairs])
    one, two = (kernels.estimate(x, trips, max_iter=5) for x in (g, plain(g)))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all() and one[2] == two[2]


def test_routes_leave_python(spark, monkeypatch):
    """Many trips are not searched one by one in Python."""
    g, _ = lattice()
    monkeypatch.setattr(kernels, "route", None)
    assert len(kernels.routes(g, [0, 5], [77, 9], g.time)[2]) == 0


@pytest.mark.parametrize("helper", [True, False])
def test_nodes_of_paths(spark, monkeypatch, helper):
    if not helper:
        monkeypatch.setattr(native, "code", lambda: b"")
    g = kernels.Graph(np.array([10, 20, 30, 40]), np.array([10, 20, 30]), np.array([20, 30, 20]), np.array([1.0, 2.0, 3.0]), np.array([5.0, 6.0, 7.0]))
    trips = spark.createDataFrame([(1, 10, 30), (2, 20, 20), (3, 40, 10), (4, None, 10), (5, 99, 10)], "trip_id long, origin long, dest long")
    got = {r[0]: tuple(r)[3:] for r in routing.route_trips(trips, g).collect()}
    none = (None, None, None)
    assert got == {1: (3.0, 11.0, [10, 20, 30]), 2: (0.0, 0.0, [20]), 3: none, 4: none, 5: none}
    assert routing.route_trips(trips, g, paths=False).columns == ["trip_id", "origin", "dest", "cost", "dist"]
