"""Batched searches over a broadcast graph.

The graph is broadcast only after its links are counted; beyond ``MAX_LINKS`` the fixpoint in ``graph`` is the way.
"""

from __future__ import annotations

from array import array
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from streetflow.operators import kernels

MAX_LINKS = 20_000_000
#: Tasks a core that searches are dealt to; trips of one destination that share a tree.
TASKS, ALIKE = 4, 50
#: Rows of link and region that are unpacked at once.
UNPACKED = 200_000
#: Sources of whole trees for which a helper starts.
FEW = 10


class GraphTooLarge(ValueError):
    """The links don't fit a broadcast; use graph.sssp and its relatives."""


def load_graph(links: DataFrame, nodes: DataFrame | None = None, max_links: int = MAX_LINKS) -> kernels.Graph:
    """Graph of links (begin_node_id, end_node_id, street_length, time); the quickest link stands for a pair of nodes."""
    # Kept on the executors, so that the links are made once: counted there, and brought to the driver only then.
    best = links.groupBy("begin_node_id", "end_node_id").agg(F.min(F.struct("time", "street_length")).alias("b"))
    best = best.select("begin_node_id", "end_node_id", "b.time", "b.street_length").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = best.count()
        if n > max_links:
            raise GraphTooLarge(f"{n} links; at most {max_links} are broadcast")
        u, v, time, length = _columns(best)
    finally:
        best.unpersist()
    order = np.lexsort((v, u))
    u, v, time, length = u[order].astype(np.int64), v[order].astype(np.int64), time[order].astype(float), length[order].astype(float)
    ids, lat, lon = np.unique(np.r_[u, v]), None, None
    if nodes is not None:
        ids, lat, lon = _columns(nodes.select("node_id", "lat", "lon"))
        ids, first = np.unique(ids.astype(np.int64), return_index=True)
        lat, lon = lat[first], lon[first]
        known = np.isin(u, ids) & np.isin(v, ids)
        u, v, time, length = u[known], v[known], time[known], length[known]
    return kernels.Graph(ids, u, v, time, length, lat, lon)


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns on the driver, as flat arrays whatever the session's setting for Arrow is."""
    rows = df.toArrow()
    return [rows[c].to_numpy() for c in df.columns]


def _deal(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over all cores, some tasks each: searches cost more than rows, so few input files must not hold them."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, *keys)


def route_trips(trips: DataFrame, g: kernels.Graph, goal: bool = False, flags=None, paths: bool = True) -> DataFrame:
    """trip_id, origin, dest, cost, dist, path (node ids) of each trip; nulls without a path.

    goal: lean the search towards the target. flags: (forward, backward, region per node number) from kernels.arc_flags.
    Without either, trips with one destination meet in a task, and ``ALIKE`` of them or more share a tree towards it.
    paths: whether the column path is wanted; without it rows stay narrow.
    """
    shared, number = trips.sparkSession.sparkContext.broadcast((g.raw(), flags)), uuid4().hex
    plain = not goal and flags is None

    def run(batches):
        for b in batches:
            raw, flags = shared.value
            g = kernels.cached_graph(number, raw)
            s, t = (_numbers(g, b[c]) for c in ("origin", "dest"))
            speed = g.max_speed(g.time) if goal else None
            alike = None
            if plain:
                _, which, many = np.unique(t, return_inverse=True, return_counts=True)
                alike = many[which] >= ALIKE
            cost, size, links = kernels.search(g, s, t, g.time, speed, flags, alike)
            none, size = size < 0, np.maximum(size, 0)
            of = np.repeat(np.arange(len(size)), size)
            columns = [*(b[c] for c in ("trip_id", "origin", "dest")), pa.array(cost, mask=none),
                       pa.array(np.bincount(of, weights=g.length[links], minlength=len(size)).astype(float), mask=none)]
            if paths:
                # A path's nodes: its first one, then the end of each link.
                nodes = np.where(none, 0, size + 1)
                ends = np.cumsum(nodes)
                at, begin = np.empty(int(nodes.sum()), np.int64), (ends - nodes)[~none]
                rest = np.ones(len(at), bool)
                rest[begin] = False
                at[begin], at[rest] = g.ids[s[~none]], g.ids[g.v[links]]
                offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[none, False])
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(at)))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "trip_id long, origin long, dest long, cost double, dist double" + ", path array<long>" * paths
    names = [x.split()[0] for x in schema.split(", ")]
    rows = trips.select(*(F.col(c).cast("long").alias(c) for c in names[:3]))
    dealt = _deal(rows, "dest").sortWithinPartitions("dest") if plain else _deal(rows, "trip_id")
    return dealt.mapInArrow(run, schema)


def _numbers(g: kernels.Graph, ids: pa.Array) -> np.ndarray:
    """The number of each node, -1 for those that are null or not in the graph."""
    if not len(g.ids):
        return np.full(len(ids), -1, np.int32)
    wanted = ids.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(g.ids, wanted), len(g.ids) - 1)
    return np.where((g.ids[at] == wanted) & ids.is_valid().to_numpy(zero_copy_only=False), at, -1).astype(np.int32)


def path_links(routed: DataFrame, *keep: str) -> DataFrame:
    """(trip_id, *keep, pos, begin_node_id, end_node_id) of the links of each path."""
    steps = F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda x, i: F.struct(x.alias("b"), F.get("path", i + 1).alias("e")))
    return routed.where(F.size("path") > 1).select("trip_id", *keep, F.posexplode(steps).alias("pos", "s")).select(
        "trip_id", *keep, "pos", F.col("s.b").alias("begin_node_id"), F.col("s.e").alias("end_node_id")
    )


def trees(sources: DataFrame, g: kernels.Graph, reverse: bool = False, most: int | None = None) -> DataFrame:
    """(source, node, cost): least costs from each source (to it, if reverse); the ``most`` nearest nodes only, if given.

    A source without links, which the graph does not know, still reaches itself. Whole trees of many sources are searched by
    the helper JVM, a batch of rows each.
    """
    shared, number = sources.sparkSession.sparkContext.broadcast(g.raw()), uuid4().hex

    def run(batches):
        for b in batches:
            g = kernels.cached_graph(number, shared.value)
            time = None
            helped = most is None and (b.num_rows >= FEW or "router" in g.__dict__) and g.router is not None
            for s in b["source"].to_pylist():
                at = g.at(int(s))
                if at is None:
                    nodes, costs = np.array([s], np.int64), np.zeros(1)
                elif helped:
                    found, costs = g.router.tree(at, g.time, reverse, most)
                    nodes = g.ids[found]
                else:
                    time = time or array("d", g.time.tobytes())
                    found = kernels.tree(g, at, time, reverse, most=most)
                    nodes, costs = g.ids[list(found)], np.array(list(found.values()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), s, np.int64)), pa.array(nodes), pa.array(costs)], ["source", "node", "cost"])

    return _deal(sources.select(F.col("source").cast("long")), "source").mapInArrow(run, "source long, node long, cost double")


def packed_flags(g: kernels.Graph, regions: DataFrame) -> DataFrame:
    """(link, forward, backward): a row for each link number, with a bit for each region in the order of ids. regions: node_id, region_id.

    The nodes are dealt over tasks; a task gives the forward flags of links out of its nodes and the backward flags of those
    into them. They stay packed where halves meet, so a link's row is small however many regions there are.
    """
    at, spark = _region_of(g, regions, -1), regions.sparkSession
    shared, number = spark.sparkContext.broadcast((g.raw(), at)), uuid4().hex
    names = _names(at)

    def run(batches):
        for b in batches:
            raw, at = shared.value
            g = kernels.cached_graph(number, raw)
            for side, (links, bits) in enumerate(kernels.flags_of(g, g.time, at, names, b["id"].to_numpy())):
                whole, none = pa.array(list(map(bytes, bits)), pa.binary()), pa.nulls(len(links), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(links, pa.int64()), *((none, whole) if side else (whole, none))], ["link", "forward", "backward"])

    jobs = _deal(spark.range(len(g.ids) if names else 0), "id")
    halves = jobs.mapInArrow(run, "link long, forward binary, backward binary")
    return halves.groupBy("link").agg(F.max("forward").alias("forward"), F.max("backward").alias("backward"))


def _names(region: np.ndarray) -> list[int]:
    return sorted(int(x) for x in np.unique(region) if x >= 0)


def arc_flags(g: kernels.Graph, regions: DataFrame) -> DataFrame:
    """(begin_node_id, end_node_id, region_id, forward, backward): packed_flags with a row for each link and region."""
    names = _names(_region_of(g, regions, -1))
    shared, number, step = regions.sparkSession.sparkContext.broadcast(g.raw()), uuid4().hex, max(1, UNPACKED // max(1, len(names)))

    def run(batches):
        for b in batches:
            g = kernels.cached_graph(number, shared.value)
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                link = part["link"].to_numpy()
                bits = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint8).reshape(len(link), -1) for c in ("forward", "backward"))
                forward, backward = (np.unpackbits(x, 1, count=len(names)).ravel().astype(bool) for x in bits)
                ends = (np.repeat(g.ids[x[link]], len(names)) for x in (g.u, g.v))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*ends, np.tile(names, len(link)), forward, backward)], columns)

    columns = ["begin_node_id", "end_node_id", "region_id", "forward", "backward"]
    return packed_flags(g, regions).mapInArrow(run, "begin_node_id long, end_node_id long, region_id long, forward boolean, backward boolean")


def _region_of(g: kernels.Graph, regions: DataFrame, missing: int) -> np.ndarray:
    node, region = _columns(regions.select("node_id", "region_id"))
    return pd.Series(region, node).reindex(g.ids).fillna(missing).to_numpy(np.int64)


def flag_matrix(g: kernels.Graph, flags: DataFrame, regions: DataFrame):
    """Packed flags as the kernels want them: (forward, backward, region column per node number)."""
    at = _region_of(g, regions, -1)
    names = _names(at)
    rows = flags.select("link", "forward", "backward").toArrow()
    k, out = rows["link"].to_numpy(), np.zeros((2, len(g.u), -(-len(names) // 8)), np.uint8)
    for side, c in enumerate(("forward", "backward")):
        if len(k):
            out[side, k] = np.frombuffer(b"".join(rows[c].to_pylist()), np.uint8).reshape(len(k), -1)
    return out[0], out[1], np.maximum(np.searchsorted(names, at), 0)
