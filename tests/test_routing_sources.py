"""Searches from a source that has no links."""

import numpy as np

from streetflow.operators import kernels, routing


def chain():
    return kernels.Graph(np.array([2, 3]), np.array([2]), np.array([3]), np.array([10.0]), np.array([100.0]))


def test_a_source_without_links_reaches_itself(spark):
    sources = spark.createDataFrame([(1,), (2,)], "source long")
    got = {(r.source, r.node, r.cost) for r in routing.trees(sources, chain()).collect()}
    assert got == {(1, 1, 0.0), (2, 2, 0.0), (2, 3, 10.0)}


def test_nearest_of_a_source_without_links(spark):
    near = routing.trees(spark.createDataFrame([(1,)], "source long"), chain(), most=10)
    assert [(r.node, r.cost) for r in near.collect()] == [(1, 0.0)]
