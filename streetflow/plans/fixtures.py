"""Road network and trips derived from the driver's tables, as text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LAT_M, LON_M = "111194.86461e0", "84253.1418965e0"


def straight(a: str, b: str) -> str:
    """Flat-earth metres between two points named by their column prefixes or aliases."""
    x, y = f"(({a}lat - {b}lat) * {LAT_M})", f"(({a}lon - {b}lon) * {LON_M})"
    return f"sqrt({x} * {x} + {y} * {y})"


VIEWS: dict[str, str] = {
    "road_nodes": """
select p_partkey as node_id,
       40.65e0 + cast((p_partkey * 7919) % 1000 as double) / 1000 * 0.25e0 as lat,
       -74.05e0 + cast((p_partkey * 104729) % 1009 as double) / 1009 * 0.20e0 as lon,
       cast(1 + p_size % 5 as bigint) as trip_weight
from part""",
    "road_links_raw": """
select begin_node_id, end_node_id, cast(min(street_length) as double) as street_length
from (select l_partkey as begin_node_id,
             lead(l_partkey) over (partition by l_orderkey
               order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as end_node_id,
             50 + l_quantity * 10 as street_length, l_linenumber
      from lineitem) x
where end_node_id is not null and begin_node_id <> end_node_id and l_linenumber = 1 and street_length <= 250
group by begin_node_id, end_node_id""",
    "road_links": f"""
select l.begin_node_id, l.end_node_id, greatest(l.street_length, {straight('a.', 'b.')}) as street_length
from road_links_raw l join road_nodes a on a.node_id = l.begin_node_id join road_nodes b on b.node_id = l.end_node_id""",
    "trips_raw": """
select event_id as trip_id, user_id, event_type, ts as pickup_datetime,
       cast(floor(value * 12) as bigint) as duration_s,
       40.58e0 + cast((event_id * 7919) % 1000 as double) / 1000 * 0.36e0 as from_lat,
       -74.10e0 + cast((event_id * 104729) % 1009 as double) / 1009 * 0.30e0 as from_lon,
       40.58e0 + cast((event_id * 15485863) % 997 as double) / 997 * 0.36e0 as to_lat,
       -74.10e0 + cast((event_id * 32452843) % 991 as double) / 991 * 0.30e0 as to_lon
from events""",
    "trips": f"""
select *, straight_line_m * (0.9e0 + cast(trip_id % 47 as double) / 10) as dist_m
from (select *, {straight('from_', 'to_')} as straight_line_m from trips_raw) t""",
    "mini_links": """
select distinct begin_node_id % 200 as a, end_node_id % 200 as b from road_links_raw where street_length <= 60""",
    # Hourly snapshots of link times, as an estimator would leave them.
    "snapshots": """
select begin_node_id, end_node_id, concat('2024-01-01 0', h, ':00:00') as slice,
       street_length / 10 * (1 + cast((begin_node_id * 7 + end_node_id * 13 + h * 31) % 50 as double) / 100) as travel_time,
       cast((begin_node_id + end_node_id * 3 + h) % 4 as bigint) as num_trips
from road_links_raw cross join (select 0 as h union all select 1 union all select 2) hours""",
    # Paths of two links with observed times: what a router would hand to the estimator, without the router.
    "paths": """
select cast(row_number() over (order by a.begin_node_id, a.end_node_id, b.end_node_id) as bigint) as trip_id,
       a.begin_node_id as o, a.end_node_id as via, b.end_node_id as d,
       (a.street_length + b.street_length) * (0.8e0 + cast((a.begin_node_id + b.end_node_id) % 9 as double) / 20) as dist_m
from road_links_raw a join road_links_raw b on a.end_node_id = b.begin_node_id""",
    "path_links": """
select trip_id, 0 as pos, o as begin_node_id, via as end_node_id, dist_m from paths
union all select trip_id, 1, via, d, dist_m from paths""",
    "path_times": """
select trip_id, k, cast(20 + (trip_id * 37 + k * 11) % 40 as double) as true_time
from paths cross join (select 0 as k union all select 1 union all select 2) x where k <= trip_id % 3""",
}
#: Each view's own needs come before it.
ORDER = list(VIEWS)
TABLES = ("part", "lineitem", "events")


class Fixtures:
    """The views over one scale folder; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                sql = VIEWS[name]
                used = {x: self[x] for x in (*TABLES, *ORDER) if x != name and _mentions(sql, x)}
                for x in used:
                    sql = _replace(sql, x)
                self.made[name] = self.spark.sql(sql, **used)
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]


def _pattern(name: str):
    import re

    return re.compile(rf"\b(from|join) {name}\b")


def _mentions(sql: str, name: str) -> bool:
    return bool(_pattern(name).search(sql))


def _replace(sql: str, name: str) -> str:
    return _pattern(name).sub(rf"\1 {{{name}}}", sql)


def oracle(sql: str) -> str:
    """sql with the views that it needs in front."""
    need: list[str] = []

    def visit(text):
        for x in ORDER:
            if _mentions(text, x) and x not in need:
                visit(VIEWS[x])
                need.append(x)

    visit(sql)
    sql = sql.strip()
    if not need:
        return sql
    heads = ",\n".join(f"{x} as ({VIEWS[x]})" for x in need)
    if sql.lower().startswith("with recursive "):
        return f"with recursive {heads},\n{sql[15:]}"
    if sql.lower().startswith("with "):
        return f"with {heads},\n{sql[5:]}"
    return f"with {heads}\n{sql}"
