"""Nearest-node matching on grid cells: by a broadcast grid of the nodes, or as equi-joins for nodes beyond ``MAX_NODES``.

Both look round by round at the 3 x 3 cells around a point and give the same nodes. The broadcast grid moves no point.
"""

from __future__ import annotations

import math
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from streetflow.functions import geo

#: Nodes per cell of the first round, and how much the cells grow from round to round.
PER_CELL, GROW = 2.0, 4
#: Nodes that are broadcast (24 bytes each); candidates that a task looks at together.
MAX_NODES, TOGETHER = 5_000_000, 1_000_000
FOUND = StructType().add("node_id", LongType()).add("d2", DoubleType())


class Grid:
    """Nodes in cells that widen round by round; numpy only. Nodes at one place are represented by the smallest id.

    box: (south, north, west, east) of points that have a nearest node at all. coarse: so many cells a side over the box;
    only nodes in the 3 x 3 coarse cells around a point's own count.
    """

    def __init__(self, ids, lat, lon, box, coarse: int | None = None):
        ok = np.isfinite(lat) & np.isfinite(lon)
        ids, lat, lon = ids[ok], lat[ok], lon[ok]
        order = np.lexsort((ids, lon, lat))
        ids, lat, lon = ids[order], lat[order], lon[order]
        new = np.r_[True, (lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1])][: len(ids)]
        self.ids, self.lat, self.lon, self.box, self.coarse = ids[new], lat[new], lon[new], box, coarse
        south, north, west, east = box
        self.span = max((north - south) * geo.LAT_METRES, (east - west) * geo.LON_METRES, 1.0)
        self.start = max(self.span / math.sqrt(max(1.0, len(self.ids) / PER_CELL)), 1e-3)
        self.rounds, self.part = {}, self.cells_of(self.lat, self.lon)

    def cells_of(self, lat, lon):
        if self.coarse is None:
            return None
        south, north, west, east = self.box
        return np.floor((lat - south) / (north - south) * self.coarse), np.floor((lon - west) / (east - west) * self.coarse)

    def round(self, size: float):
        """(nodes in the order of their cells, keys of the cells, where each begins, lowest column, columns) of a cell width."""
        if size not in self.rounds:
            cy, cx = (np.floor(x * m / size).astype(np.int64) for x, m in ((self.lat, geo.LAT_METRES), (self.lon, geo.LON_METRES)))
            low, wide = int(cx.min()) - 1, int(cx.max() - cx.min()) + 3
            key = cy * wide + (cx - low)
            order = np.argsort(key, kind="stable")
            cells, first = np.unique(key[order], return_index=True)
            self.rounds[size] = order, cells, np.r_[first, len(order)], low, wide
        return self.rounds[size]

    def nearest(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, square metres) of each point; infinity where there is none."""
        south, north, west, east = self.box
        node, d2 = np.zeros(len(lat), np.int64), np.full(len(lat), np.inf)
        inside = (lat >= south) & (lon >= west)
        inside &= (lat <= north) & (lon <= east) if self.coarse is None else (lat < north) & (lon < east)
        todo, size = np.flatnonzero(inside) if len(self.ids) else np.empty(0, np.int64), self.start
        part = self.cells_of(lat, lon)
        while len(todo):
            order, cells, first, low, wide = self.round(size)
            cy, cx = (np.floor(x[todo] * m / size).astype(np.int64) for x, m in ((lat, geo.LAT_METRES), (lon, geo.LON_METRES)))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    column = cx + dx - low
                    key = (cy + dy) * wide + column
                    at = np.minimum(np.searchsorted(cells, key), len(cells) - 1)
                    hit = np.flatnonzero((cells[at] == key) & (column >= 0) & (column < wide))
                    many = first[at[hit] + 1] - first[at[hit]]
                    for some in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(many) // TOGETHER)) + 1):
                        if len(some):
                            self.look(todo[hit[some]], first[at[hit[some]]], many[some], order, lat, lon, part, node, d2)
            if size >= self.span:
                break
            todo, size = todo[~(d2[todo] <= size * size)], size * GROW
        return node, d2

    def look(self, who, start, many, order, lat, lon, part, node, d2):
        """Compares each point (who) with the nodes of one cell."""
        begin = np.cumsum(many) - many
        k = order[np.repeat(start - begin, many) + np.arange(int(many.sum()))]
        i = np.repeat(who, many)
        y, x = (lat[i] - self.lat[k]) * geo.LAT_METRES, (lon[i] - self.lon[k]) * geo.LON_METRES
        away = y * y + x * x
        if part is not None:
            away[(np.abs(part[0][i] - self.part[0][k]) > 1) | (np.abs(part[1][i] - self.part[1][k]) > 1)] = np.inf
        least = np.minimum.reduceat(away, begin)
        best = np.minimum.reduceat(np.where(away == np.repeat(least, many), self.ids[k], np.iinfo(np.int64).max), begin)
        better = (least < d2[who]) | ((least == d2[who]) & (least < np.inf) & (best < node[who]))
        node[who[better]], d2[who[better]] = best[better], least[better]


_GRIDS: dict = {}


def _looked_up(number: str, shared, lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
    if number not in _GRIDS:
        # A match has two ends at most, and both use one grid.
        _GRIDS.clear()
        _GRIDS[number] = Grid(*shared.value)
    node, d2 = _GRIDS[number].nearest(lat.to_numpy(float), lon.to_numpy(float))
    none = ~np.isfinite(d2)
    return pd.DataFrame({"node_id": pd.arrays.IntegerArray(node, none), "d2": np.where(none, np.nan, d2)})


def grid_of(nodes: DataFrame, coarse: int | None = None, margin: float = 0.0):
    """lookup(lat, lon): the column (node_id, d2) of the nearest nodes by a broadcast grid. None for more nodes than ``MAX_NODES``."""
    if nodes.count() > MAX_NODES:
        return None
    rows = nodes.where("lat is not null and lon is not null").select("node_id", "lat", "lon").toArrow()
    ids, lat, lon = (rows[c].to_numpy() for c in ("node_id", "lat", "lon"))
    box = (lat.min(), lat.max() + margin, lon.min(), lon.max() + margin) if len(ids) else (0.0, 0.0, 0.0, 0.0)
    shared = nodes.sparkSession.sparkContext.broadcast((ids.astype(np.int64), lat.astype(float), lon.astype(float), box, coarse))
    number = uuid4().hex

    def lookup(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
        return _looked_up(number, shared, lat, lon)

    return F.pandas_udf(lookup, FOUND)


def _metre_grid(df: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    return df.withColumns({"cy": F.floor(F.col(lat) * geo.LAT_METRES / size), "cx": F.floor(F.col(lon) * geo.LON_METRES / size)})


def nearest_nodes(points: DataFrame, nodes: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, node_id, d2): the nearest node of each point, by squared metres, then node id; null outside the nodes' extent."""
    lookup = grid_of(nodes)
    if lookup is None:
        return nearest_by_joins(points, nodes, key, lat, lon)
    return points.select(key, lookup(lat, lon).alias("b")).select(key, "b.node_id", "b.d2")


def nearest_by_joins(points: DataFrame, nodes: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """nearest_nodes for any number of nodes, a row per key.

    Round by round the points look at the 3 x 3 cells around their own. A find within one cell width is final; the other
    points go on with cells ``GROW`` times as wide, until one cell spans the extent. One row (the extent) goes to the
    driver.
    """
    e = nodes.agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.count("*").alias("k")
    ).first()
    none = points.select(key, F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("double").alias("d2"))
    if not e.k:
        return none
    inside = F.col(lat).between(e.s, e.n) & F.col(lon).between(e.w, e.e)
    out = none.where(F.lit(False)).unionByName(points.where(~F.coalesce(inside, F.lit(False))).select(none.columns[0],
        F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("double").alias("d2")))
    open_points = points.where(inside).select(key, F.col(lat).alias("plat"), F.col(lon).alias("plon"))
    span = max((e.n - e.s) * geo.LAT_METRES, (e.e - e.w) * geo.LON_METRES, 1.0)
    size = max(span / math.sqrt(max(1.0, e.k / PER_CELL)), 1e-3)
    while True:
        last = size >= span
        cells = _metre_grid(nodes.select("node_id", "lat", "lon"), "lat", "lon", size)
        steps = F.array(*(F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        looked = _metre_grid(open_points, "plat", "plon", size).withColumn("d", F.explode(steps))
        looked = looked.withColumns({"cy": F.col("cy") + F.col("d.dy"), "cx": F.col("cx") + F.col("d.dx")})
        y, x = (F.col("plat") - F.col("lat")) * geo.LAT_METRES, (F.col("plon") - F.col("lon")) * geo.LON_METRES
        best = (
            looked.join(cells, ["cy", "cx"], "left")
            .groupBy(key, "plat", "plon")
            .agg(F.min(F.when(F.col("node_id").isNotNull(), F.struct((y * y + x * x).alias("d2"), "node_id"))).alias("b"))
        )
        final = F.lit(True) if last else F.coalesce(F.col("b.d2") <= size * size, F.lit(False))
        out = out.unionByName(best.where(final).select(key, "b.node_id", "b.d2"))
        if last:
            return out
        open_points, size = best.where(~final).select(key, "plat", "plon"), size * GROW


def nearest_in_grid(points: DataFrame, nodes: DataFrame, key: str, lat: str, lon: str, cells: int = 20) -> DataFrame:
    """The older lookup: nodes in the 3 x 3 cells of a fixed grid over the extent; null if none lies there."""
    lookup = grid_of(nodes, cells, 0.01)
    if lookup is None:
        return nearest_in_grid_by_joins(points, nodes, key, lat, lon, cells)
    return points.select(key, lookup(lat, lon)["node_id"].alias("node_id"))


def nearest_in_grid_by_joins(points: DataFrame, nodes: DataFrame, key: str, lat: str, lon: str, cells: int = 20) -> DataFrame:
    """nearest_in_grid for any number of nodes; the pairs of points and nodes of neighbouring cells are all made."""
    e = nodes.agg(
        F.min("lat").alias("s"), (F.max("lat") + 0.01).alias("n"), F.min("lon").alias("w"), (F.max("lon") + 0.01).alias("e")
    )
    def cell(df, la, lo):
        return df.crossJoin(F.broadcast(e)).withColumns(
            {"cy": F.floor((F.col(la) - F.col("s")) / (F.col("n") - F.col("s")) * cells),
             "cx": F.floor((F.col(lo) - F.col("w")) / (F.col("e") - F.col("w")) * cells)}
        ).drop("s", "n", "w", "e")

    steps = F.array(*(F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    mine = cell(points.select(key, F.col(lat).alias("plat"), F.col(lon).alias("plon")), "plat", "plon")
    mine = mine.where(F.col("cy").between(0, cells - 1) & F.col("cx").between(0, cells - 1)).withColumn("d", F.explode(steps))
    mine = mine.withColumns({"cy": F.col("cy") + F.col("d.dy"), "cx": F.col("cx") + F.col("d.dx")})
    y, x = (F.col("plat") - F.col("lat")) * geo.LAT_METRES, (F.col("plon") - F.col("lon")) * geo.LON_METRES
    found = mine.join(cell(nodes.select("node_id", "lat", "lon"), "lat", "lon"), ["cy", "cx"])
    best = found.groupBy(key).agg(F.min(F.struct((y * y + x * x).alias("d2"), "node_id")).alias("b"))
    return points.select(key).join(best.select(key, "b.node_id"), key, "left")


def match_trips(trips: DataFrame, nodes: DataFrame) -> DataFrame:
    """trips with origin and dest: the nearest nodes of both ends, null outside the extent."""
    lookup = grid_of(nodes)
    if lookup is not None:
        for side, name in (("from", "origin"), ("to", "dest")):
            trips = trips.withColumn(name, lookup(f"{side}_lat", f"{side}_lon")["node_id"])
        return trips
    out = trips
    for side, name in (("from", "origin"), ("to", "dest")):
        found = nearest_by_joins(trips, nodes, "trip_id", f"{side}_lat", f"{side}_lon")
        out = out.join(found.select("trip_id", F.col("node_id").alias(name)), "trip_id", "left")
    return out


def collapse(matched: DataFrame) -> DataFrame:
    """One row per (origin, dest): the first trip's distance, all times in trip order, and their number."""
    both = matched.where(F.col("origin").isNotNull() & F.col("dest").isNotNull())
    return both.groupBy("origin", "dest").agg(
        F.min("trip_id").alias("trip_id"),
        F.min_by("dist_m", "trip_id").alias("dist_m"),
        F.transform(F.sort_array(F.collect_list(F.struct("trip_id", "duration_s"))), lambda x: x["duration_s"]).alias("dup_times"),
        F.count("*").alias("num_occurrences"),
    )
