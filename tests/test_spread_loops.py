"""Loops on the driver with spread routes give what loops in tasks give."""

import random

import numpy as np
import pytest

from streetflow.operators import estimate as est
from tests.test_graph import lattice


def trips(spark, n=120):
    r = random.Random(3)
    rows = [(i, "ab"[i % 2], r.randrange(144), r.randrange(144), 500.0, [r.uniform(30, 200)], 5.0) for i in range(n)]
    return spark.createDataFrame(rows, "trip_id long, slice string, origin long, dest long, dist_m double, dup_times array<double>, mean_speed double")


@pytest.mark.parametrize("where", [True, False])
def test_both_kinds_of_loops_agree(spark, monkeypatch, where):
    g, _ = lattice()
    monkeypatch.setattr(est, "_loops_on_driver", lambda s, jobs: where)
    used = []
    spread = est.spread_router
    monkeypatch.setattr(est, "spread_router", lambda *a: used.append(1) or spread(*a))
    e = est.estimate_by(trips(spark), "slice", g, 3).orderBy("slice", *est.PAIR).toPandas()
    f = trips(spark).selectExpr("trip_id % 3 as fold", "trip_id as at", "origin", "dest", "dist_m", "dup_times[0] as duration_s")
    c = est.cross_validate(f, g, 3, 2).orderBy("fold", "iteration").toPandas()
    assert used == [1, 1] * where
    assert len(e) == 2 * len(g.u) and e["error"].isna().all() and (e["mean_abs_last"] <= e["mean_abs_first"]).all()
    monkeypatch.setattr(est, "_loops_on_driver", lambda s, jobs: not where)
    other = est.estimate_by(trips(spark), "slice", g, 3).orderBy("slice", *est.PAIR).toPandas()
    again = est.cross_validate(f, g, 3, 2).orderBy("fold", "iteration").toPandas()
    assert np.allclose(e["time"], other["time"]) and np.allclose(e["num_trips"], other["num_trips"])
    assert np.allclose(c.drop(columns="variant").astype(float), again.drop(columns="variant").astype(float))


def test_a_learning_curve_tests_at_the_end(spark):
    g, _ = lattice()
    f = trips(spark).selectExpr("trip_id % 2 as fold", "trip_id as at", "origin", "dest", "dist_m", "dup_times[0] as duration_s")
    whole = est.cross_validate(f, g, 2, 2).toPandas().sort_values(["fold", "iteration"]).groupby("fold").last()
    last = est.cross_validate(f, g, 2, 2, sizes=[1.0]).toPandas().sort_values(["fold", "iteration"]).groupby("fold", as_index=True).tail(1).set_index("fold")
    assert np.allclose(whole["test_abs"], last["test_abs"])
