"""Partitions of the road graph: spectral, balanced, modularity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from streetflow.plans.cut import cut

#: Vectors beside the wanted ones, and the residual (as a share of a bound of the eigenvalues) that ends the search.
SPARE, SETTLED = 4, 1e-6


def modularity(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of labels (node, label) on undirected links (a, b)."""
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = links.join(la, "a").join(lb, "b")
    ends = joined.select(F.explode(F.array("la", "lb")).alias("label"))
    deg = ends.groupBy("label").agg(F.count("*").alias("d"))
    inner = joined.agg(F.count("*").alias("m"), F.coalesce(F.sum((F.col("la") == F.col("lb")).cast("long")), F.lit(0)).alias("inside"))
    both = deg.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("dd")).crossJoin(inner)
    m = F.nullif(F.col("m").cast("double"), F.lit(0.0))
    return both.select((F.col("inside") / m - F.col("dd") / (4 * m * m)).alias("modularity"))


def lowest_eigenvectors(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, k: int, seed: int = 1) -> np.ndarray:
    """n x k: eigenvectors of the k lowest eigenvalues of the symmetric part of a sparse n x n matrix (entries i, j, v).

    A block of vectors goes on inside the span of itself, its residuals and its last move (locally optimal conjugate
    gradients). Of an eigenvalue that many vectors share, some basis is found, as by any method.
    """
    i, j, v = np.r_[i, j, np.arange(n)], np.r_[j, i, np.arange(n)], np.r_[v, v, np.zeros(n)] / 2
    order = np.argsort(i, kind="stable")
    i, j, v = i[order], j[order], v[order]
    starts = np.searchsorted(i, np.arange(n))
    top = float(np.add.reduceat(np.abs(v), starts).max())

    def times(x):
        return np.stack([np.add.reduceat(v * row[j], starts) for row in x])

    m = min(n, k + SPARE)
    x, move = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n if n <= 3 * m else m)))[0].T, np.empty((0, n))
    while True:
        y = times(x)
        value, turn = np.linalg.eigh(x @ y.T)
        x, y = turn.T @ x, turn.T @ y
        off = y - value[:, None] * x
        if len(x) == n or np.abs(off[:k]).max() <= SETTLED * top:
            return x[:k].T
        span = np.linalg.qr(np.concatenate([x, off, move]).T)[0].T
        _, turn = np.linalg.eigh(span @ times(span).T)
        x, move = turn[:, :m].T @ span, turn[m:, :m].T @ span[m:]


def spectral_clusters(lap: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(node, cluster): k-means on the k lowest eigenvectors of a Laplacian (i, j, v), whose entries go to the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = lap.select("i", "j", "v").toArrow()
    i, j, v = (rows[c].to_numpy() for c in "ijv")
    ids = np.unique(i)
    vectors = lowest_eigenvectors(np.searchsorted(ids, i), np.searchsorted(ids, j), v.astype(float), len(ids), k, seed)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), vectors.shape[1]).cast(pa.list_(pa.float64()))
    points = pa.table({"node": pa.array(ids.astype(np.int64)), "e": lists})
    df = lap.sparkSession.createDataFrame(points).withColumn("features", array_to_vector("e"))
    model = KMeans(k=min(k, max(2, len(ids))), seed=seed).fit(df)
    return model.transform(df).select("node", F.col("prediction").cast("long").alias("cluster"))


def balanced_partition(links: DataFrame, start: DataFrame, rounds: int = 5, imbalance: float = 0.03) -> DataFrame:
    """(node, label): labels moved to where most neighbours are, while no label outgrows its share.

    start: (node, label). Each round the nodes that would gain most move, as many per label as it has room for.
    """
    labels = cut(start)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    cap = int(np.ceil(labels.count() / max(1, sizes.count()) * (1 + imbalance)))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.count("*").alias("c"))
        mine = labels.withColumnRenamed("label", "own")
        best = near.groupBy("node").agg(F.max(F.struct("c", (-F.col("label")).alias("neg"))).alias("m"))
        own = near.join(mine, "node").where("label = own").select("node", F.col("c").alias("own_c"))
        want = best.join(mine, "node").join(own, "node", "left").select(
            "node", "own", (-F.col("m.neg")).alias("to"), (F.col("m.c") - F.coalesce("own_c", F.lit(0))).alias("gain")
        ).where("to <> own and gain > 0")
        room = labels.groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").alias("to"), (F.lit(cap) - F.col("n")).alias("room"))
        rank = F.row_number().over(W.partitionBy("to").orderBy(F.desc("gain"), "node"))
        moves = want.join(room, "to").withColumn("r", rank).where("r <= room").select("node", "to")
        labels = cut(labels.join(moves, "node", "left").select("node", F.coalesce("to", "label").alias("label")))
    return labels


def affinity(near: DataFrame, sigma: float) -> DataFrame:
    """(i, j, v): exp(-(cost / sigma)^2) of the nearest nodes (source, node, cost), made symmetric by the larger value."""
    v = F.exp(-F.pow(F.col("cost") / sigma, F.lit(2)))
    one = near.select(F.col("source").alias("i"), F.col("node").alias("j"), v.alias("v"))
    return one.union(one.select("j", "i", "v")).groupBy("i", "j").agg(F.max("v").alias("v"))
