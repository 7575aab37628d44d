"""Slice tables, retries, and parts of the estimation loop that SQL does not show."""

import numpy as np
import pytest

from streetflow.operators import estimate as est
from streetflow.operators import kernels
from streetflow.sources import tables


def test_life_cycle(spark, tmp_path):
    t = tables.SliceTable(spark, "arc_flags", str(tmp_path / "flags"))
    assert not t.exists() and t.size() == 0
    t.create()
    assert t.exists()
    f = spark.createDataFrame(
        [(1, 2, "a", [0, 1, 0], [0, 0, 0]), (2, 3, "a", [0, 0, 0], [0, 0, 0]), (1, 2, "b", [1, 1, 1], [1, 0, 0])],
        "begin_node_id long, end_node_id long, slice string, forward array<int>, backward array<int>",
    )
    t.save(tables.arc_flag_rows(f))
    assert [r.slice for r in t.dates().collect()] == ["a", "b"] and t.load().count() == 4 and t.size() > 0
    t.save(tables.arc_flag_rows(f.where("slice = 'a'").limit(1)))
    links = f.select("begin_node_id", "end_node_id").distinct()
    got = {(r[0], r[1]): (r.forward, r.backward) for r in tables.apply_arc_flags(links, t.load("b"), 3).collect()}
    assert got == {(1, 2): ([1, 1, 1], [1, 0, 0]), (2, 3): ([0, 0, 0], [0, 0, 0])}
    t.delete("a")
    assert [r.slice for r in t.dates().collect()] == ["b"]
    t.drop()
    assert not t.exists()


def test_retry():
    calls = []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return 7

    assert tables.with_retry(action, 3, 0) == 7
    with pytest.raises(OSError):
        calls.clear()
        tables.with_retry(action, 2, 0)


def chain():
    ids = np.array([1, 2, 3])
    return kernels.Graph(ids, np.array([1, 2]), np.array([2, 3]), np.array([10.0, 10.0]), np.array([100.0, 100.0]))


def test_estimate_starts_at_the_speed_given():
    """1 to 3 over 200 m in 25 s: at 10 m/s the first error is 5 s, at 8 m/s none."""
    trips = kernels.Observed([0], [2], [200.0], [[25.0]])
    for speed, error in ((10.0, 5.0), (8.0, 0.0), (None, 0.0)):
        _, _, train, _ = kernels.estimate(chain(), trips, max_iter=1, speed=speed)
        assert train[0][0] == pytest.approx(error)


def test_failed_slices_stay(spark):
    rows = [("00", 1, 3, 200.0, [25.0], 10.0), ("01", 1, 3, 200.0, None, 10.0)]
    df = spark.createDataFrame(rows, "slice string, origin long, dest long, dist_m double, dup_times array<double>, mean_speed double")
    got = est.estimate_by(df, "slice", chain(), max_iter=20).collect()
    good = [r for r in got if r.error is None]
    assert {r.slice for r in good} == {"00"} and len(good) == 2 and good[0].mean_abs_first == pytest.approx(5.0)
    assert sum(r.time for r in good) == pytest.approx(25.0, abs=0.1)
    assert [r.slice for r in got if r.error] == ["01"]
