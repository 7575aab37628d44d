"""Whole trees by the compiled searches equal those in Python, in the same order."""

import numpy as np
import pytest

from streetflow.operators import kernels, native, routing
from tests.test_flags_and_pieces import sparse
from tests.test_graph import lattice


@pytest.mark.parametrize("make", [lattice, sparse, lambda: sparse(120, 400, 7, True)])
def test_trees_equal_those_in_python(spark, make):
    g, _ = make()
    time = g.time.copy()
    time[::17] = 0
    for reverse in (False, True):
        for i in range(0, len(g.ids), 7):
            found = kernels.tree(g, i, time.tolist(), reverse)
            nodes, costs = g.router.tree(i, time, reverse, None)
            assert nodes.tolist() == list(found) and costs.tolist() == list(found.values())
            assert g.router.tree(i, time, reverse, 3)[0].tolist() == list(found)[:3]


@pytest.mark.parametrize("helper", [True, False])
def test_rows_of_trees(spark, monkeypatch, helper):
    """With the helper no tree is searched in Python, and both give the same rows; an unknown source reaches itself."""
    if not helper:
        monkeypatch.setattr(native, "code", lambda: b"")
    monkeypatch.setattr(routing, "FEW", 1 if helper else 10**9)
    g, _ = lattice()
    sources = [int(x) for x in g.ids[:20]] + [10**6]
    rows = routing.trees(spark.createDataFrame([(s,) for s in sources], "source long"), g, reverse=True).collect()
    want = {(s, int(g.ids[k]), c) for s in sources[:-1] for k, c in kernels.tree(g, g.at(s), g.time.tolist(), True).items()}
    assert {tuple(r) for r in rows} == want | {(10**6, 10**6, 0.0)} and len(rows) == len(want) + 1
