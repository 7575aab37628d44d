"""Arc flags of the catalog: as many regions as the reference takes, by the compiled searches, packed on their way."""

import numpy as np
import pytest

from streetflow.operators import kernels, routing
from streetflow.plans import catalog
from streetflow.plans.fixtures import Fixtures
from tests.test_flags_and_pieces import flags_by_all_trees, sparse
from tests.test_graph import lattice


def test_regions_of_the_reference(spark):
    """createMap(250): leaves of a 62nd of the trips, whose two ends weigh one each, so 124 leaves and 128 by halving."""
    fx = Fixtures(spark, "/root/testdata/sf0.01")
    assert catalog.flag_regions(fx).select("region_id").distinct().count() == 128


def star(n=150):
    """A node with more links than a word has bits, and a long way round."""
    u = np.r_[np.zeros(n - 1, int), np.arange(1, n)]
    v = np.r_[np.arange(1, n), np.arange(2, n), [0]]
    w = np.random.default_rng(3).integers(1, 9, len(u)).astype(float)
    return kernels.Graph(np.arange(n), u, v, w, w), np.arange(n) % 11


@pytest.mark.parametrize("make", [lattice, sparse, star, lambda: sparse(seed=6, whole=True), lambda: sparse(120, 400, 7, True)])
@pytest.mark.parametrize("helper", [True, False])
def test_compiled_flags_equal_those_of_all_trees(spark, make, helper):
    g, region = make()
    g = kernels.Graph(*g.raw()[:-1], None if helper else b"")
    regions = sorted(set(region.tolist()))
    want = flags_by_all_trees(g, g.time.tolist(), region, regions)
    got = kernels.arc_flags(g, g.time, region, regions)
    assert ("router" in g.__dict__) and (g.router is not None) == helper
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_rows_and_matrix_equal_the_flags(spark):
    g, region = lattice()
    r = spark.createDataFrame([(int(i), int(x)) for i, x in zip(g.ids, region)], "node_id long, region_id long")
    names = sorted(set(region.tolist()))
    want = kernels.arc_flags(g, g.time, region, names)
    place = {(g.ids[a], g.ids[b]): k for k, (a, b) in enumerate(zip(g.u, g.v))}
    rows = routing.arc_flags(g, r).collect()
    assert len(rows) == len(g.u) * len(names) == len({x[:3] for x in rows})
    for x in rows:
        k, c = place[x.begin_node_id, x.end_node_id], names.index(x.region_id)
        assert (x.forward, x.backward) == (want[0][k, c], want[1][k, c])
    f, b, at = routing.flag_matrix(g, routing.packed_flags(g, r), r)
    assert (np.unpackbits(f, 1, count=len(names)) == want[0]).all() and (np.unpackbits(b, 1, count=len(names)) == want[1]).all()
    assert (np.array(names)[at] == region).all()
    s, t = np.arange(140), np.arange(140)[::-1].copy()
    cost = kernels.search(g, s, t, g.time)[0]
    for x in (g, kernels.Graph(*g.raw()[:-1], b"")):
        assert np.allclose(kernels.search(x, s, t, g.time, flags=(f, b, at))[0], cost, equal_nan=True)
