"""Searches leave out nodes that cannot lie on a path, and still find every path."""

import random

import numpy as np
import pytest

from streetflow.operators import kernels


def graph(n, links, seed):
    r = random.Random(seed)
    pairs = sorted({(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(links)) if a != b})
    u, v = (np.array(x) for x in zip(*pairs))
    return kernels.Graph(np.arange(n), u, v, np.array([r.uniform(1, 9) for _ in pairs]), np.ones(len(pairs)), code=b"")


def test_dead_ends_are_not_followed(monkeypatch):
    # A ring, with many ways that lead nowhere from each of its nodes, and many that come from nowhere.
    ring = [(i, (i + 1) % 10) for i in range(10)]
    out = [(i % 10, 10 + i) for i in range(2000)]
    into = [(2010 + i, i % 10) for i in range(2000)]
    u, v = (np.array(x) for x in zip(*ring, *out, *into))
    g = kernels.Graph(np.arange(4010), u, v, np.ones(len(u)), np.ones(len(u)), code=b"")
    pushed = []
    push = kernels.heappush
    monkeypatch.setattr(kernels, "heappush", lambda h, x: pushed.append(x) or push(h, x))
    time = g.time.tolist()
    assert kernels.route(g, 0, 7, time)[0] == 7 and kernels.route(g, 2010, 10 + 7, time)[0] == 9
    assert kernels.route(g, 10, 0, time) is None
    assert len(pushed) < 100


@pytest.mark.parametrize("n, links, near", [(60, 70, 256), (60, 70, 2), (200, 330, 256), (40, 160, 256)])
def test_every_path_is_found(monkeypatch, n, links, near):
    monkeypatch.setattr(kernels, "NEAR", near)
    g = graph(n, links, n + links)
    time = g.time.tolist()
    for s in range(n):
        far = kernels.tree(g, s, time)
        for t in range(n):
            got = kernels.route(g, s, t, time)
            assert (got is None) == (t not in far)
            assert got is None or got[0] == pytest.approx(far[t])


def test_the_helper_agrees(spark):
    from streetflow.operators import native

    for n, links in ((300, 350), (2000, 3300), (2000, 2400)):
        plain = graph(n, links, n)
        g = kernels.Graph(*plain.raw()[:-1], native.code())
        r = np.random.default_rng(n)
        s, t = r.integers(0, n, 1000), r.integers(0, n, 1000)
        one, two = kernels.search(g, s, t, g.time), None
        assert g.router is not None
        monkey, kernels.FEW = kernels.FEW, 10**9
        try:
            two = kernels.search(plain, s, t, plain.time)
        finally:
            kernels.FEW = monkey
        for x, y in zip(one, two):
            assert np.array_equal(x, y, equal_nan=x.dtype.kind == "f")
