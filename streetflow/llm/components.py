"""Connected components of an edge table by alternating large-star and small-star rounds.

Both rounds keep one row per edge, so a star with a huge centre is never gathered: the minimum per node is a partial
aggregate, and the join that follows is one that adaptive execution can split. Rounds grow with the logarithm of the
component size. Only two numbers per round reach the driver. An edge table of at most ``SMALL_EDGES`` rows (counted) is
solved by one task on an executor, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from streetflow.llm import scratch

SMALL_EDGES = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(i):
        parent.setdefault(i, i)
        return i

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist()):
            p, q = find(add(u)), find(add(v))
            parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "root": [find(i) for i in nodes]}, dtype="int64")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node that has an edge, the smallest node that can be reached from it.

    a and b are long columns without nulls; loops and repeated edges are allowed. An empty edge table gives an empty
    result.
    """
    now = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    now = scratch.stage(now, "edges")
    if now.count() <= SMALL_EDGES:
        return now.repartition(1).mapInPandas(_solve, "node long, root long")
    seen = None
    while True:
        after = scratch.stage(_small_star(_large_star(now)), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
        scratch.drop(now)
        now = after
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
