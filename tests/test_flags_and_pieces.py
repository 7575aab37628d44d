"""Arc flags by local searches, and what the compressed rows answer."""

import random

import numpy as np
import pytest

from streetflow.operators import kernels
from tests.test_graph import lattice


def flags_by_all_trees(g, time, region, regions):
    """A tree to and from every boundary node: the plain way."""
    w, n = np.asarray(time), len(g.ids)
    at = kernels.boundary_region(g, region)
    flags = np.zeros((2, len(w), len(regions)), bool)
    for c, r in enumerate(regions):
        flags[:, (region[g.u] == r) | (region[g.v] == r), c] = True
        for b in np.flatnonzero(at == r).tolist():
            for side in (0, 1):
                cost = np.full(n, np.inf)
                found = kernels.tree(g, b, time, reverse=side == 0)
                cost[list(found)] = list(found.values())
                a, z = (g.u, g.v) if side == 0 else (g.v, g.u)
                ok = np.isfinite(cost[z])
                flags[side, ok, c] |= np.abs(cost[a[ok]] - (w[ok] + cost[z[ok]])) <= 1e-9 * np.maximum(1.0, cost[a[ok]])
    return flags


def sparse(n=150, m=220, seed=5, whole=False):
    r = np.random.default_rng(seed)
    pairs = np.unique(r.integers(0, n, (m, 2)), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    w = r.integers(1, 4, len(pairs)) if whole else r.uniform(1, 9, len(pairs))
    return kernels.Graph(np.arange(n), pairs[:, 0], pairs[:, 1], w.astype(float), 10.0 * w), r.integers(0, 3, n)


@pytest.mark.parametrize("make", [lattice, sparse, lambda: sparse(seed=6, whole=True), lambda: sparse(120, 400, 7, True)])
def test_flags_equal_those_of_all_trees(make):
    g, region = make()
    regions = sorted(set(region.tolist()))
    want = flags_by_all_trees(g, g.time.tolist(), region, regions)
    got = kernels.arc_flags(g, g.time.tolist(), region, regions)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_no_search_between_pieces():
    """Two long chains: a path from one to the other is refused before anything is searched."""
    a = np.r_[np.arange(9999), 10_000 + np.arange(9999)]
    g = kernels.Graph(np.arange(20_000), a, a + 1, np.ones(len(a)), np.ones(len(a)))
    assert kernels.route(g, 0, 19_999, None) is None
    assert set(g.piece.tolist()) == {0, 10_000}


def test_ways_to_a_target_equal_routes():
    g, _ = sparse(100, 300)
    t = g.time.tolist()
    r = random.Random(2)
    for d in r.sample(range(100), 10):
        found = kernels.ways(g, d, t)
        for s in range(100):
            x, y = kernels.way(g, s, d, found, t), kernels.route(g, s, d, t)
            assert (x is None) == (y is None) and (x is None or x[0] == pytest.approx(y[0]))
