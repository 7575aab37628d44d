"""Spectral embedding."""

import numpy as np
import pyarrow as pa

from streetflow.operators import partition


def ring(n):
    """Laplacian of a ring with chords."""
    a = np.arange(n)
    u, v = np.r_[a, a[::7]], np.r_[(a + 1) % n, (a[::7] * 3 + 5) % n]
    m = np.zeros((n, n))
    keep = u != v
    m[u[keep], v[keep]] = m[v[keep], u[keep]] = 1
    return np.diag(m.sum(axis=1)) - m


def test_lowest_eigenvectors_are_those_of_the_dense_matrix():
    lap = ring(300)
    i, j = np.nonzero(lap)
    got = partition.lowest_eigenvectors(i, j, lap[i, j], 300, 4)
    values, vectors = np.linalg.eigh(lap)
    assert np.allclose(np.linalg.norm(lap @ got - got * values[:4], axis=0), 0, atol=1e-4)
    assert np.allclose(got.T @ got, np.eye(4)) and np.allclose(np.linalg.norm(vectors[:, :4].T @ got), 2, atol=1e-5)


def test_more_nodes_than_a_dense_matrix_takes(spark):
    """21,000 nodes, which the dense decomposition refused."""
    n = 21_000
    r = np.random.default_rng(1)
    a = np.arange(n)
    b = r.permutation(n)
    i, j = np.r_[a, b, a, (a + 1) % n, a], np.r_[b, a, (a + 1) % n, a, a]
    v = np.r_[np.full(4 * n, -0.25), np.ones(n)]
    lap = spark.createDataFrame(pa.table({"i": i, "j": j, "v": v}))
    got = partition.spectral_clusters(lap, 2).toPandas()
    assert sorted(got["node"]) == a.tolist()
