"""Registered queries: each applies operators to the fixtures; most have the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window as W, functions as F

from streetflow.functions import flags as hexflags
from streetflow.functions import geo
from streetflow.functions import trips as trip
from streetflow.operators import estimate as est
from streetflow.operators import graph, labels, legacy, network, partition, regions, routing
from streetflow.operators import nearest
from streetflow.plans.cut import rounded
from streetflow.plans.fixtures import Fixtures, oracle
from streetflow.sources import store, tables

REGISTRY: dict[str, tuple[Callable[[Fixtures], DataFrame], str | None]] = {}
PAIR = network.ENDS
MILE = "1609.34e0"


def query(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = (f, oracle(sql) if sql else None)
        return f

    return add


def r6(c):
    return F.round(c, 6)


def timed(fx: Fixtures, links: str = "road_links_raw") -> DataFrame:
    """Links at 10 m/s."""
    return fx[links].withColumn("time", F.col("street_length") / 10)


def hour_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:00:00")


# ---------------------------------------------------------------- network

BOX = "lon > -74.0e0 and lon < -73.9e0 and lat > 40.7e0 and lat < 40.85e0"
SMALL_BOX = (-74.0, 40.85, -73.9, 40.7)


@query("load_nodes_bbox", f"select node_id, lat, lon from road_nodes where {BOX}")
def _(fx):
    return network.clip_nodes(fx["road_nodes"], SMALL_BOX).select("node_id", "lat", "lon")


@query(
    "load_links_semi",
    f"""with n as (select node_id from road_nodes where {BOX}),
k as (select * from road_links_raw where begin_node_id in (select * from n) and end_node_id in (select * from n))
select begin_node_id, end_node_id, street_length,
       cast(row_number() over (order by begin_node_id, end_node_id) - 1 as bigint) as link_id from k""",
)
def _(fx):
    return network.number_links(network.keep_links(fx["road_links_raw"], network.clip_nodes(fx["road_nodes"], SMALL_BOX)))


@query(
    "node_degrees",
    """select node_id, coalesce(i.n, 0) as num_in_links, coalesce(o.n, 0) as num_out_links from road_nodes
left join (select end_node_id, count(*) as n from road_links_raw group by 1) i on i.end_node_id = node_id
left join (select begin_node_id, count(*) as n from road_links_raw group by 1) o on o.begin_node_id = node_id""",
)
def _(fx):
    return network.degrees(fx["road_nodes"].select("node_id"), fx["road_links_raw"])


UND = "select distinct least(begin_node_id, end_node_id) as a, greatest(begin_node_id, end_node_id) as b from road_links_raw"


@query("undirected_edges", UND)
def _(fx):
    return network.undirected(fx["road_links_raw"])


@query(
    "metis_lines",
    f"""with u as ({UND}), e as (select a, b from u union all select b, a from u),
n as (select node_id, row_number() over (order by node_id) as k from road_nodes),
t as (select a, string_agg(cast(k as varchar), ' ' order by k) as s from e join n on n.node_id = b group by a)
select node_id, coalesce(s, '') as line from road_nodes left join t on a = node_id""",
)
def _(fx):
    return network.metis_lines(fx["road_links_raw"], fx["road_nodes"])


@query(
    "links_by_pair",
    """with d as (select begin_node_id % 50 as begin_node_id, end_node_id % 50 as end_node_id, street_length,
  cast(row_number() over (order by begin_node_id, end_node_id) as bigint) as link_id from road_links_raw)
select begin_node_id, end_node_id, max(link_id) as link_id, arg_max(street_length, link_id) as street_length
from d group by begin_node_id, end_node_id""",
)
def _(fx):
    l = network.number_links(fx["road_links_raw"])
    return network.last_by_pair(l.select((F.col(PAIR[0]) % 50).alias(PAIR[0]), (F.col(PAIR[1]) % 50).alias(PAIR[1]), "street_length", (F.col("link_id") + 1).alias("link_id")))


@query(
    "delete_nodes",
    """select begin_node_id, end_node_id, street_length, cast(row_number() over (order by begin_node_id, end_node_id) - 1 as bigint) as link_id
from road_links_raw where begin_node_id % 7 <> 0 and end_node_id % 7 <> 0""",
)
def _(fx):
    return network.delete_nodes(fx["road_nodes"], fx["road_links_raw"], fx["road_nodes"].where("node_id % 7 = 0"))[1]


@query("blacklist_nodes", "select node_id from road_nodes where node_id not in (select begin_node_id from road_links_raw)")
def _(fx):
    black = fx["road_links_raw"].select(F.col("begin_node_id").alias("node_id"))
    return fx["road_nodes"].select("node_id").join(black, "node_id", "left_anti")


@query(
    "meld_links",
    """select l.begin_node_id, l.end_node_id, coalesce(round(l.street_length / s.travel_time, 6), -1e0) as speed, coalesce(round(s.travel_time, 6), -1e0) as time
from road_links_raw l left join (select * from snapshots where slice = '2024-01-01 01:00:00' and num_trips > 1) s
on l.begin_node_id = s.begin_node_id and l.end_node_id = s.end_node_id""",
)
def _(fx):
    s = fx["snapshots"].where("slice = '2024-01-01 01:00:00' and num_trips > 1").select(*PAIR, "travel_time")
    return fx["road_links_raw"].join(s, PAIR, "left").select(
        *PAIR,
        F.coalesce(r6(F.col("street_length") / F.col("travel_time")), F.lit(-1.0)).alias("speed"),
        F.coalesce(r6("travel_time"), F.lit(-1.0)).alias("time"),
    )


@query(
    "apply_speed_csv",
    """select l.begin_node_id, l.end_node_id, l.street_length, round(l.street_length / s.travel_time, 6) as speed, round(s.travel_time, 6) as time
from road_links_raw l join snapshots s on l.begin_node_id = s.begin_node_id and l.end_node_id = s.end_node_id where slice = '2024-01-01 00:00:00'""",
)
def _(fx):
    s = fx["snapshots"].where("slice = '2024-01-01 00:00:00'").select(*PAIR, "travel_time")
    return fx["road_links_raw"].join(s, PAIR).select(
        *PAIR, "street_length", r6(F.col("street_length") / F.col("travel_time")).alias("speed"), r6("travel_time").alias("time")
    )


PACED = """select l.begin_node_id as start_node_id, l.end_node_id, a.lat as start_lat, a.lon as start_lon, b.lat as end_lat, b.lon as end_lon,
 round(l.time / l.street_length, 6) as pace, l.num_trips
from (select l.*, s.travel_time as time, s.num_trips from road_links_raw l join snapshots s
      on l.begin_node_id = s.begin_node_id and l.end_node_id = s.end_node_id where slice = '2024-01-01 00:00:00') l
join road_nodes a on a.node_id = l.begin_node_id join road_nodes b on b.node_id = l.end_node_id"""


def snapped(fx):
    s = fx["snapshots"].where("slice = '2024-01-01 00:00:00'").select(*PAIR, F.col("travel_time").alias("time"), "num_trips")
    return fx["road_links_raw"].join(s, PAIR)


@query("pace_table", PACED + " where time > 0 and num_trips >= 2")
def _(fx):
    return network.pace_table(snapped(fx), fx["road_nodes"], 2).withColumn("pace", r6("pace"))


@query(
    "pace_table_dict",
    """select l.begin_node_id, l.end_node_id, a.lat as start_lat, a.lon as start_lon, b.lat as end_lat, b.lon as end_lon, d.pace
from (select begin_node_id, end_node_id, round(travel_time / 7, 6) as pace from snapshots where slice = '2024-01-01 02:00:00' and num_trips = 3) d
join road_links_raw l on l.begin_node_id = d.begin_node_id and l.end_node_id = d.end_node_id
join road_nodes a on a.node_id = l.begin_node_id join road_nodes b on b.node_id = l.end_node_id""",
)
def _(fx):
    d = fx["snapshots"].where("slice = '2024-01-01 02:00:00' and num_trips = 3").select(*PAIR, r6(F.col("travel_time") / 7).alias("pace"))
    return network.with_nodes(fx["road_links_raw"].select(*PAIR).join(d, PAIR), fx["road_nodes"])


@query(
    "adjacent_streets",
    """with l as (select begin_node_id as b, end_node_id as e from road_links_raw), e as (select * from l where (b + e) % 3 = 0)
select distinct l.b as begin_node_id, l.e as end_node_id, e.b as adj_begin_node_id, e.e as adj_end_node_id
from l join e on (l.b = e.b or l.b = e.e or l.e = e.b or l.e = e.e) and not (l.b = e.b and l.e = e.e)""",
)
def _(fx):
    l = fx["road_links_raw"]
    return network.adjacent_streets(l, l.where("(begin_node_id + end_node_id) % 3 = 0"))


@query("adjacency", f"with u as ({UND}), n as (select a as x from u union select b from u) select a as i, b as j, 1e0 as v from u union all select b, a, 1e0 from u union all select x, x, 1e0 from n")
def _(fx):
    return network.adjacency(fx["road_links_raw"])


LAP = f"""with u as ({UND}), n as (select a as x from u union select b from u),
adj as (select a as i, b as j, 1e0 as v from u union all select b, a, 1e0 from u union all select x, x, 1e0 from n),
d as (select i, sum(v) as d from adj group by i)"""


@query("laplacian", LAP + " select adj.i, j, case when adj.i = j then d - v else -v end as v from adj join d on d.i = adj.i")
def _(fx):
    return network.laplacian(network.adjacency(fx["road_links_raw"]))


@query(
    "laplacian_normalised",
    LAP + """ select adj.i, adj.j, round(case when adj.i = adj.j then 1 - v / sqrt(p.d * q.d) else -v / sqrt(p.d * q.d) end, 6) as v
from adj join d p on p.i = adj.i join d q on q.i = adj.j""",
)
def _(fx):
    return network.laplacian(network.adjacency(fx["road_links_raw"]), normalised=True).withColumn("v", r6("v"))


@query("max_speed", "select round(max(street_length / travel_time), 6) as max_speed from road_links_raw l join snapshots s using (begin_node_id, end_node_id) where travel_time > 0")
def _(fx):
    l = fx["road_links_raw"].join(fx["snapshots"], PAIR).where("travel_time > 0")
    return l.agg(r6(F.max(F.col("street_length") / F.col("travel_time"))).alias("max_speed"))


@query(
    "default_speed",
    """select round(street_length / travel_time, 6) as default_speed from road_links_raw l join snapshots s using (begin_node_id, end_node_id)
where slice = '2024-01-01 00:00:00' order by begin_node_id, end_node_id limit 1""",
)
def _(fx):
    return snapped(fx).agg(r6(F.min_by(F.col("street_length") / F.col("time"), F.struct(*PAIR))).alias("default_speed"))


@query("node_extent", "select min(lat) as south, max(lat) + 0.01e0 as north, min(lon) as west, max(lon) + 0.01e0 as east from road_nodes")
def _(fx):
    return fx["road_nodes"].agg(F.min("lat").alias("south"), (F.max("lat") + 0.01).alias("north"), F.min("lon").alias("west"), (F.max("lon") + 0.01).alias("east"))


# ---------------------------------------------------------------- trips


@query("find_pickup", "select trip_id, pickup_datetime from trips where pickup_datetime between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-03 00:00:00'")
def _(fx):
    return store.between(fx["trips"], "pickup_datetime", "2024-01-02 00:00:00", "2024-01-03 00:00:00").select("trip_id", "pickup_datetime")


DROP = "pickup_datetime + duration_s * interval '1' second"


@query("find_dropoff", f"select trip_id, duration_s from trips where {DROP} between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-03 00:00:00'")
def _(fx):
    t = fx["trips"].withColumn("dropoff_datetime", F.expr("pickup_datetime + make_interval(0, 0, 0, 0, 0, 0, duration_s)"))
    return store.between(t, "dropoff_datetime", "2024-01-02 00:00:00", "2024-01-03 00:00:00").select("trip_id", "duration_s")


@query("find_dow_hod", "select trip_id from trips where isodow(pickup_datetime) - 1 = 2 and hour(pickup_datetime) = 8")
def _(fx):
    return fx["trips"].where((F.weekday("pickup_datetime") == 2) & (F.hour("pickup_datetime") == 8)).select("trip_id")


@query("approx_distance", "select trip_id, round(straight_line_m, 6) as metres from trips")
def _(fx):
    c = [F.col(x) for x in ("from_lat", "from_lon", "to_lat", "to_lon")]
    return fx["trips_raw"].select("trip_id", r6(geo.metres(*c)).alias("metres"))


@query(
    "trip_features",
    f"""with x as (select trip_id, duration_s, case when trip_id % 11 = 0 then 'n/a' else cast(value as varchar) end as d,
  from_lat, from_lon, to_lat, to_lon from trips_raw join (select event_id, value from events) e on event_id = trip_id),
y as (select *, try_cast(d as double) is not null as fine from x),
z as (select trip_id, duration_s, case when fine then cast(d as double) * {MILE} else 0e0 end as m,
  case when fine then sqrt((from_lat - to_lat) * 111194.86461e0 * ((from_lat - to_lat) * 111194.86461e0) + (from_lon - to_lon) * 84253.1418965e0 * ((from_lon - to_lon) * 84253.1418965e0)) else 0e0 end as s from y)
select trip_id, round(m, 4) as dist_m, round(case when m = 0 then 0e0 else duration_s / m end, 6) as pace, round(s, 4) as straight_line_m,
  round(case when s <= 0 then 1e0 else m / s end, 6) as winding from z""",
)
def _(fx):
    e = fx.spark.read.parquet(f"{fx.sf_dir}/events.parquet").select(F.col("event_id").alias("trip_id"), "value")
    t = fx["trips_raw"].join(e, "trip_id").select(
        "trip_id", "duration_s",
        F.when(F.col("trip_id") % 11 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("trip_distance"),
        *(F.col(a).cast("string").alias(b) for a, b in (("from_lon", "pickup_longitude"), ("from_lat", "pickup_latitude"),
                                                        ("to_lon", "dropoff_longitude"), ("to_lat", "dropoff_latitude"))),
    )
    out = trip.raw_features(t)
    return out.select("trip_id", F.round("dist_m", 4).alias("dist_m"), r6("pace").alias("pace"), F.round("straight_line_m", 4).alias("straight_line_m"), r6("winding").alias("winding"))


OUT = lambda a, b, c, d: " or ".join(f"{p}_lat < {a} or {p}_lat > {b} or {p}_lon < {c} or {p}_lon > {d}" for p in ("from", "to"))
VALID = f"""(select *, case
 when strftime(pickup_datetime, '%Y-%m') in ('2010-08', '2010-09') then 23
 when {OUT('40.4e0', '41.1e0', '-74.25e0', '-73.5e0')} then 2
 when line < 0.001e0 * {MILE} then 5 when line > 20 * {MILE} then 6
 when dist_m < 0.001e0 * {MILE} then 8 when dist_m > 20 * {MILE} then 10
 when wind < 0.95e0 then 13 when duration_s < 10 then 17 when duration_s > 7200 then 18
 when pc < 10 / {MILE} then 21 when pc > 7200 / {MILE} then 22
 when {OUT('40.6e0', '40.9e0', '-74.05e0', '-73.7e0')} then 1
 when line > 8 * {MILE} then 4 when dist_m > 15 * {MILE} then 8 when wind > 5 then 12
 when duration_s < 60 then 15 when duration_s > 3600 then 16
 when pc < 40 / {MILE} then 19 when pc > 3600 / {MILE} then 20 else 0 end as code
 from (select *, straight_line_m as line, case when straight_line_m <= 0 then 1e0 else dist_m / straight_line_m end as wind,
   case when dist_m = 0 then 0e0 else duration_s / dist_m end as pc from trips) t0)"""


@query("trip_validity", f"select code, count(*) as n from {VALID} v group by code")
def _(fx):
    return fx["trips"].groupBy(trip.validity().alias("code")).agg(F.count("*").alias("n"))


@query(
    "distance_weights",
    """with t as (select trip_id, dist_m, straight_line_m - dist_m as e from trips)
select trip_id, round(exp(-((e / 400) * (e / 400))), 6) as abs_gauss, round(1 - least(1, abs(e / 4000)), 6) as abs_lasso,
 case when e < 100 then 1e0 else 0e0 end as abs_threshold, round(exp(-((e / nullif(dist_m, 0) / 0.5e0) * (e / nullif(dist_m, 0) / 0.5e0))), 6) as rel_gauss from t""",
)
def _(fx):
    w = lambda *s: trip.distance_weight(*s, F.col("dist_m"), F.col("straight_line_m"))
    return fx["trips"].select(
        "trip_id", r6(w("abs", "gauss", 400.0)).alias("abs_gauss"), r6(w("abs", "lasso", 4000.0)).alias("abs_lasso"),
        w("abs", "threshold", 100.0).alias("abs_threshold"), r6(w("rel", "gauss", 0.5)).alias("rel_gauss"),
    )


@query("hour_of_week", "select cast(isodow(pickup_datetime) % 7 as bigint) as dow, cast(hour(pickup_datetime) as bigint) as hod, count(*) as n from trips group by all")
def _(fx):
    dow, hod = (F.dayofweek("pickup_datetime") - 1).cast("long"), F.hour("pickup_datetime").cast("long")
    return fx["trips"].groupBy(dow.alias("dow"), hod.alias("hod")).agg(F.count("*").alias("n"))


@query("job_sizes", "select cast(isodow(pickup_datetime) - 1 as bigint) as weekday, cast(hour(pickup_datetime) as bigint) as hour, count(*) as size from trips where pickup_datetime >= timestamp '2024-01-01' and pickup_datetime < timestamp '2024-01-08' group by all")
def _(fx):
    t = fx["trips"].where("pickup_datetime >= '2024-01-01' and pickup_datetime < '2024-01-08'")
    return t.groupBy(F.weekday("pickup_datetime").cast("long").alias("weekday"), F.hour("pickup_datetime").cast("long").alias("hour")).agg(F.count("*").alias("size"))


@query("slice_calendar", "select strftime(x, '%Y-%m-%d %H:00:00') as slice from range(timestamp '2010-01-01', timestamp '2014-01-01', interval 1 hour) r(x)")
def _(fx):
    hours = F.expr("sequence(timestamp_ntz'2010-01-01 00:00:00', timestamp_ntz'2013-12-31 23:00:00', interval 1 hour)")
    return fx.spark.range(1).select(F.explode(hours).alias("x")).select(hour_text("x").alias("slice"))


CAL = "(select x as h from range(timestamp '2024-01-01', timestamp '2024-02-01', interval 1 hour) r(x))"


@query("trips_per_hour", f"select strftime(h, '%Y-%m-%d %H:00:00') as slice, count(trip_id) as n from {CAL} c left join trips on pickup_datetime >= h and pickup_datetime <= h + interval 1 hour group by h")
def _(fx):
    """Both ends count, so a trip on the hour is in two slices."""
    hours = F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-31 23:00:00', interval 1 hour)")
    cal = fx.spark.range(1).select(F.explode(hours).alias("h")).select(hour_text("h").alias("slice"))
    t = fx["trips"].select(F.col("pickup_datetime").alias("p"))
    on_hour = (F.minute("p") == 0) & (F.date_format("p", "ss.SSSSSS") == "00.000000")
    also = F.when(on_hour, hour_text(F.expr("p - interval 1 hour")))
    n = t.select(F.explode(F.array_compact(F.array(hour_text("p"), also))).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"))
    return cal.join(n, "slice", "left").select("slice", F.coalesce("n", F.lit(0)).alias("n"))


@query("lpt_order", "with s as (select strftime(pickup_datetime, '%Y-%m-%d %H:00:00') as slice, count(*) as size from trips group by 1) select slice, size, row_number() over (order by size desc, slice) as job from s")
def _(fx):
    s = fx["trips"].groupBy(hour_text("pickup_datetime").alias("slice")).agg(F.count("*").alias("size"))
    return s.withColumn("job", F.row_number().over(W.orderBy(F.desc("size"), "slice")).cast("long"))


@query("avg_velocity", "select round(sum(dist_m) / nullif(sum(duration_s), 0), 4) as velocity from trips")
def _(fx):
    return est.avg_velocity(fx["trips"]).select(F.round("velocity", 4).alias("velocity"))


JFK = "{p}_lon > -73.825207e0 and {p}_lon < -73.751907e0 and {p}_lat > 40.622843e0 and {p}_lat < 40.665305e0"


@query(
    "jfk_share",
    f"""with t as (select strftime(pickup_datetime, '%Y-%m-%d') as day,
 cast(({JFK.format(p='from')}) or ({JFK.format(p='to')}) as int) as jfk, cast(from_lat <= 40.65e0 or from_lat >= 40.9e0 or from_lon <= -74.05e0 or from_lon >= -73.85e0 as int) as outside from trips),
d as (select day, sum(jfk) as jfk, sum(outside) as outside, count(*) as n from t group by day)
select day, cast(sum(jfk) over w as bigint) as jfk, cast(sum(outside) over w as bigint) as outside, cast(sum(n) over w as bigint) as n, round(sum(jfk) over w / cast(sum(outside) over w as double), 6) as share
from d window w as (order by day rows between unbounded preceding and current row)""",
)
def _(fx):
    airport = [geo.in_box(F.col(f"{p}_lat"), F.col(f"{p}_lon"), geo.AIRPORT_BOX) for p in ("from", "to")]
    outside = ~geo.in_box(F.col("from_lat"), F.col("from_lon"), geo.CITY_BOX)
    d = fx["trips"].groupBy(F.date_format("pickup_datetime", "yyyy-MM-dd").alias("day")).agg(
        F.sum((airport[0] | airport[1]).cast("int")).alias("j"), F.sum(outside.cast("int")).alias("o"), F.count("*").alias("c")
    )
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    d = d.select("day", F.sum("j").over(w).alias("jfk"), F.sum("o").over(w).alias("outside"), F.sum("c").over(w).alias("n"))
    return d.withColumn("share", r6(F.col("jfk") / F.nullif(F.col("outside").cast("double"), F.lit(0.0))))


@query("legacy_trip_filters", "select trip_id from trips where not (from_lat = to_lat and from_lon = to_lon) and duration_s between 120 and 3600 and dist_m / duration_s >= 0.5e0 and dist_m / duration_s <= 30")
def _(fx):
    speed = F.col("dist_m") / F.nullif(F.col("duration_s"), F.lit(0))
    loop = (F.col("from_lat") == F.col("to_lat")) & (F.col("from_lon") == F.col("to_lon"))
    return fx["trips"].where(~loop & F.col("duration_s").between(120, 3600) & speed.between(0.5, 30)).select("trip_id")


@query("threshold_counts", "select k as threshold, count(*) as links from snapshots join (select * from (values (0), (1), (2), (3)) t(k)) on num_trips >= k group by k")
def _(fx):
    """One pass: links per trip count, then running totals over the few counts."""
    n = fx["snapshots"].groupBy("num_trips").agg(F.count("*").alias("n"))
    t = fx.spark.createDataFrame([(k,) for k in range(4)], "threshold int")
    return t.join(n, F.col("num_trips") >= F.col("threshold")).groupBy("threshold").agg(F.sum("n").alias("links"))


@query(
    "color_scale",
    """select begin_node_id, end_node_id, round(greatest(0, least(1, (travel_time / street_length * 26.8224e0 - 1) / 14)), 6) as pace_color,
round(greatest(0, least(1, street_length / travel_time * 2.23694e0 / 35)), 6) as speed_color from road_links_raw l join snapshots s using (begin_node_id, end_node_id) where slice = '2024-01-01 00:00:00'""",
)
def _(fx):
    l, p = snapped(fx), F.col("time") / F.col("street_length")
    return l.select(*PAIR, r6(hexflags.color_scale(p * 26.8224, 1.0, 15.0)).alias("pace_color"), r6(hexflags.color_scale(2.23694 / p, 0.0, 35.0)).alias("speed_color"))


@query("split_range", "select cast(n as bigint) as n, cast(k as bigint) as k, i as segment, n * i // k as first, n * (i + 1) // k as past from (values (10, 3), (100, 7), (5, 8)) t(n, k), range(8) r(i) where i < k")
def _(fx):
    t = fx.spark.createDataFrame([(10, 3), (100, 7), (5, 8)], "n long, k long")
    t = t.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return t.select("n", "k", "segment", F.expr("n * segment div k").alias("first"), F.expr("n * (segment + 1) div k").alias("past"))


@query(
    "unique_growth",
    """with p as (select trip_id, cast(floor(from_lat * 20) as bigint) as a, cast(floor(to_lat * 20) as bigint) as b from trips),
f as (select trip_id, row_number() over (partition by a, b order by trip_id) = 1 as fresh from p)
select trip_id // 500 as block, cast(sum(sum(cast(fresh as int))) over (order by trip_id // 500) as bigint) as pairs from f group by 1""",
)
def _(fx):
    """First places of pairs, counted per block; the running total is over blocks, not rows."""
    p = fx["trips"].select("trip_id", F.floor(F.col("from_lat") * 20).alias("a"), F.floor(F.col("to_lat") * 20).alias("b"))
    first = p.groupBy("a", "b").agg(F.min("trip_id").alias("t")).groupBy(F.floor(F.col("t") / 500).alias("block")).agg(F.count("*").alias("n"))
    blocks = p.select(F.floor(F.col("trip_id") / 500).alias("block")).distinct()
    run = W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    return blocks.join(first, "block", "left").select("block", F.sum(F.coalesce("n", F.lit(0))).over(run).alias("pairs"))


@query("legacy_collapse", "select cast(floor(from_lat * 20) as bigint) as o, cast(floor(to_lat * 20) as bigint) as d, round(avg(duration_s), 6) as time, round(avg(dist_m), 3) as dist, count(*) as n from trips group by 1, 2")
def _(fx):
    t = fx["trips"].groupBy(F.floor(F.col("from_lat") * 20).alias("o"), F.floor(F.col("to_lat") * 20).alias("d"))
    return t.agg(r6(F.avg("duration_s")).alias("time"), F.round(F.avg("dist_m"), 3).alias("dist"), F.count("*").alias("n"))


# ---------------------------------------------------------------- matching

EXT = "(select min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as e from road_nodes)"
NEAR = f"""select trip_id, node_id from (
 select t.trip_id, d.node_id, row_number() over (partition by t.trip_id order by
  ((t.{{p}}_lat - d.lat) * 111194.86461e0) * ((t.{{p}}_lat - d.lat) * 111194.86461e0) + ((t.{{p}}_lon - d.lon) * 84253.1418965e0) * ((t.{{p}}_lon - d.lon) * 84253.1418965e0), d.node_id) as k
 from {{t}} t join {EXT} x on {{p}}_lat between s and n and {{p}}_lon between w and e cross join road_nodes d) q where k = 1"""


@query("nearest_node", f"select t.trip_id, node_id from trips t left join ({NEAR.format(p='from', t='trips')}) z using (trip_id)")
def _(fx):
    return nearest.nearest_nodes(fx["trips"], fx["road_nodes"], "trip_id", "from_lat", "from_lon").select("trip_id", "node_id")


@query(
    "match_collapse",
    f"""with v as (select trip_id, dist_m, duration_s, from_lat, from_lon, to_lat, to_lon from {VALID} v0 where code = 0),
o as ({NEAR.format(p='from', t='v')}), d as ({NEAR.format(p='to', t='v')})
select o.node_id as origin, d.node_id as dest, min(v.trip_id) as trip_id, round(arg_min(dist_m, v.trip_id), 3) as dist_m,
 cast(sum(duration_s) as bigint) as total_time, count(*) as num_occurrences from v join o using (trip_id) join d using (trip_id) group by 1, 2""",
)
def _(fx):
    c = nearest.collapse(nearest.match_trips(fx["trips"].where(trip.validity() == 0), fx["road_nodes"]))
    total = F.aggregate("dup_times", F.lit(0).cast("long"), lambda s, x: s + x)
    return c.select("origin", "dest", "trip_id", F.round("dist_m", 3).alias("dist_m"), total.alias("total_time"), "num_occurrences")


@query(
    "trip_weights",
    f"""with v as (select * from {VALID} v0 where code = 0), o as ({NEAR.format(p='from', t='v')}), d as ({NEAR.format(p='to', t='v')}),
u as (select distinct o.node_id as a, d.node_id as b from o join d using (trip_id)),
w as (select node_id, count(*) as n from (select a as node_id from u union all select b from u) x group by 1)
select r.node_id, 1 + coalesce(n, 0) as weight from road_nodes r left join w using (node_id)""",
)
def _(fx):
    c = nearest.collapse(nearest.match_trips(fx["trips"].where(trip.validity() == 0), fx["road_nodes"]))
    w = c.select(F.explode(F.array("origin", "dest")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
    return fx["road_nodes"].join(w, "node_id", "left").select("node_id", (F.coalesce("n", F.lit(0)) + 1).alias("weight"))


@query(
    "nearest_node_grid",
    """with x as (select min(lat) as s, max(lat) + 0.01e0 as n, min(lon) as w, max(lon) + 0.01e0 as e from road_nodes),
d as (select node_id, lat, lon, floor((lat - s) / (n - s) * 20) as cy, floor((lon - w) / (e - w) * 20) as cx from road_nodes, x),
t as (select trip_id, from_lat, from_lon, floor((from_lat - s) / (n - s) * 20) as ty, floor((from_lon - w) / (e - w) * 20) as tx from trips, x),
m as (select trip_id, node_id, row_number() over (partition by trip_id order by
 ((from_lat - lat) * 111194.86461e0) * ((from_lat - lat) * 111194.86461e0) + ((from_lon - lon) * 84253.1418965e0) * ((from_lon - lon) * 84253.1418965e0), node_id) as k
 from t join d on abs(cy - ty) <= 1 and abs(cx - tx) <= 1 where ty between 0 and 19 and tx between 0 and 19)
select t.trip_id, m.node_id from t left join m on m.trip_id = t.trip_id and k = 1""",
)
def _(fx):
    return nearest.nearest_in_grid(fx["trips"], fx["road_nodes"], "trip_id", "from_lat", "from_lon")


# ---------------------------------------------------------------- storage


@query("available_slices", "select distinct slice from snapshots")
def _(fx):
    return fx["snapshots"].select("slice").distinct()


@query(
    "travel_time_rows",
    """select begin_node_id, end_node_id, slice, round(travel_time, 4) as travel_time, num_trips from snapshots where num_trips > 0
union all select distinct 0, 0, slice, 7.5e0, 0 from snapshots""",
)
def _(fx):
    default = fx["snapshots"].select("slice").distinct().withColumn("speed", F.lit(7.5))
    return store.travel_time_rows(fx["snapshots"], default).withColumn("travel_time", F.round("travel_time", 4))


@query(
    "apply_travel_times",
    """select l.begin_node_id, l.end_node_id, round(coalesce(travel_time, l.street_length / 7.5e0), 6) as time,
 round(l.street_length / coalesce(travel_time, l.street_length / 7.5e0), 6) as speed, coalesce(num_trips, 0) as num_trips
from road_links_raw l left join (select * from snapshots where slice = '2024-01-01 02:00:00' and num_trips > 0) s
on l.begin_node_id = s.begin_node_id and l.end_node_id = s.end_node_id""",
)
def _(fx):
    default = fx["snapshots"].select("slice").distinct().withColumn("speed", F.lit(7.5))
    rows = store.travel_time_rows(fx["snapshots"], default).where("slice = '2024-01-01 02:00:00'")
    out = store.apply_travel_times(fx["road_links_raw"], rows)
    return out.select(*PAIR, r6("time").alias("time"), r6("speed").alias("speed"), "num_trips")


@query("link_counts", "select begin_node_id, end_node_id, round(avg(num_trips), 6) as avg_num_trips, round(avg(cast(num_trips > 0 as int)), 6) as perc_obs from snapshots group by all")
def _(fx):
    return store.link_counts(fx["snapshots"]).select(*PAIR, r6("avg_num_trips").alias("avg_num_trips"), r6("perc_obs").alias("perc_obs"))


BITS = "(select begin_node_id, end_node_id, p, cast((begin_node_id * (p + 3) + end_node_id) % 3 = 0 as int) as f from road_links_raw, range(16) r(p))"


def flag_arrays(fx):
    p = F.sequence(F.lit(0), F.lit(15))
    return fx["road_links_raw"].select(*PAIR, F.transform(p, lambda x: ((F.col(PAIR[0]) * (x + 3) + F.col(PAIR[1])) % 3 == 0).cast("int")).alias("flags"))


@query("arcflag_hex", f"with d as (select begin_node_id, end_node_id, p // 4 as g, sum(f << cast(3 - p % 4 as int)) as v from {BITS} b group by all) select begin_node_id, end_node_id, string_agg(substr('0123456789abcdef', cast(v + 1 as int), 1), '' order by g) as hex from d group by all")
def _(fx):
    return flag_arrays(fx).select(*PAIR, hexflags.to_hex(F.col("flags")).alias("hex"))


@query("arcflag_decode", f"select begin_node_id, end_node_id, cast(p as bigint) as region_id, f as flag from {BITS} b")
def _(fx):
    h = flag_arrays(fx).select(*PAIR, hexflags.to_hex(F.col("flags")).alias("hex"))
    out = h.select(*PAIR, F.posexplode(hexflags.from_hex(F.col("hex"), 16)).alias("region_id", "flag"))
    return out.withColumn("region_id", F.col("region_id").cast("long"))


STORED = """(select begin_node_id, end_node_id, string_agg(substr('0123456789abcdef', cast(v + 1 as int), 1), '' order by h) as arc_flag_forward,
  string_agg(substr('0123456789abcdef', cast(w + 1 as int), 1), '' order by h) as arc_flag_backward
  from (select begin_node_id, end_node_id, p // 4 as h, sum(f << cast(3 - p % 4 as int)) as v, sum(g << cast(3 - p % 4 as int)) as w
        from (select begin_node_id, end_node_id, p, cast((begin_node_id * (p + 3) + end_node_id) % 97 = 0 as int) as f,
              cast((begin_node_id + end_node_id * (p + 5)) % 89 = 0 as int) as g from road_links_raw, range(16) r(p)) b group by all) d
  group by all having sum(v) + sum(w) > 0)"""


def stored_flags(fx):
    p, a, b = F.sequence(F.lit(0), F.lit(15)), F.col(PAIR[0]), F.col(PAIR[1])
    forward = F.transform(p, lambda x: ((a * (x + 3) + b) % 97 == 0).cast("int"))
    backward = F.transform(p, lambda x: ((a + b * (x + 5)) % 89 == 0).cast("int"))
    f = fx["road_links_raw"].select(*PAIR, F.lit("2012-03-05 09:00:00").alias("slice"), forward.alias("forward"), backward.alias("backward"))
    return tables.arc_flag_rows(f)


@query("arc_flag_rows", f"select begin_node_id, end_node_id, '2012-03-05 09:00:00' as slice, arc_flag_forward, arc_flag_backward from {STORED} s union all select cast(0 as bigint), cast(0 as bigint), '2012-03-05 09:00:00', '0', '0'")
def _(fx):
    return stored_flags(fx)


@query(
    "arc_flag_links",
    """select begin_node_id, end_node_id, cast(sum(cast((begin_node_id * (p + 3) + end_node_id) % 97 = 0 as int) << cast(p as int)) as bigint) as forward,
 cast(sum(cast((begin_node_id + end_node_id * (p + 5)) % 89 = 0 as int) << cast(p as int)) as bigint) as backward from road_links_raw, range(16) r(p) group by all""",
)
def _(fx):
    """Flags stored, loaded onto the links, and read as numbers."""
    links = tables.apply_arc_flags(fx["road_links_raw"].select(*PAIR), stored_flags(fx), 16)
    number = lambda c: sum((F.shiftleft(F.get(c, F.lit(k)), k) for k in range(1, 16)), F.get(c, F.lit(0))).cast("long").alias(c)
    return links.select(*PAIR, number("forward"), number("backward"))


@query("region_flags", "select begin_node_id, end_node_id, cast((begin_node_id * 10 + end_node_id) % 97 = 0 as int) + 0e0 as pace from road_links_raw")
def _(fx):
    return tables.region_flags(tables.apply_arc_flags(fx["road_links_raw"].select(*PAIR), stored_flags(fx), 16), 7)


@query("speed_rows", "select begin_node_id, end_node_id, street_length as length, round(street_length / (street_length / 10), 6) as speed, round(street_length / 10, 6) as time from road_links_raw")
def _(fx):
    return tables.speed_rows(timed(fx)).select(*PAIR, "length", r6("speed").alias("speed"), r6("time").alias("time"))


@query("first_trips", "select trip_id from trips order by pickup_datetime, trip_id limit 100")
def _(fx):
    return tables.first_trips(fx["trips"], 100).select("trip_id")


@query("scheme_label", "select trip_id, case when trip_id % 4 = 0 then 'none' else case when trip_id % 2 = 0 then 'ABS' else 'REL' end || '_' || case when trip_id % 3 = 0 then 'GAUSS' else 'LASSO' end || '_' || cast(duration_s as varchar) end as label from trips")
def _(fx):
    i = F.col("trip_id")
    kernel = F.when(i % 4 != 0, F.when(i % 3 == 0, "gauss").otherwise("lasso"))
    return fx["trips"].select("trip_id", labels.scheme_label(F.when(i % 2 == 0, "abs").otherwise("rel"), kernel, F.col("duration_s")).alias("label"))


@query("legacy_timestamp", "select trip_id, cast(date_trunc('second', pickup_datetime) as timestamp) as at from trips")
def _(fx):
    return fx["trips"].select("trip_id", labels.legacy_timestamp(F.date_format("pickup_datetime", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("at"))


@query(
    "compare_paths",
    """with a as (select trip_id, begin_node_id, end_node_id from path_links), b as (select * from a where (begin_node_id + trip_id) % 3 <> 0)
select a.trip_id, count(*) as links_one, count(b.trip_id) as links_two, count(b.trip_id) as shared, round(sum(l.street_length / 10), 6) as time_one,
 round(coalesce(sum(case when b.trip_id is not null then l.street_length / 10 end), 0), 6) as time_two
from a left join b using (trip_id, begin_node_id, end_node_id) join road_links_raw l using (begin_node_id, end_node_id) group by 1""",
)
def _(fx):
    one = fx["path_links"].select("trip_id", *PAIR).distinct()
    c = labels.compare_paths(one, one.where("(begin_node_id + trip_id) % 3 <> 0"), timed(fx))
    return c.select("trip_id", "links_one", "links_two", "shared", r6("time_one").alias("time_one"), r6("time_two").alias("time_two"))


@query(
    "zscore_links",
    """with x as (select begin_node_id, end_node_id, slice, travel_time as t, avg(travel_time) over w as m, stddev_pop(travel_time) over w as s
 from snapshots window w as (partition by begin_node_id, end_node_id)) select begin_node_id, end_node_id, slice, round((t - m) / nullif(s, 0), 4) + 0e0 as z from x where s > 1e-9""",
)
def _(fx):
    w = W.partitionBy(*PAIR)
    x = fx["snapshots"].withColumns({"m": F.avg("travel_time").over(w), "s": F.stddev_pop("travel_time").over(w)})
    return x.where("s > 1e-9").select(*PAIR, "slice", (F.round((F.col("travel_time") - F.col("m")) / F.col("s"), 4) + F.lit(0.0)).alias("z"))


@query("zscore_long", "with a as (select slice, row_number() over (partition by slice order by begin_node_id, end_node_id) - 1 as pos, num_trips as z from snapshots), l as (select begin_node_id, end_node_id, row_number() over (order by begin_node_id, end_node_id) - 1 as pos from road_links_raw) select slice, begin_node_id, end_node_id, z from a join l using (pos)")
def _(fx):
    """Vectors per slice laid over one link order."""
    v = fx["snapshots"].groupBy("slice").agg(F.transform(F.sort_array(F.collect_list(F.struct(*PAIR, "num_trips"))), lambda x: x["num_trips"]).alias("v"))
    long = v.select("slice", F.posexplode("v").alias("link_id", "z"))
    l = network.number_links(fx["road_links_raw"]).select(*PAIR, "link_id")
    return long.join(l, "link_id").select("slice", *PAIR, "z")


# ---------------------------------------------------------------- regions


def kd_sql(depth: int, weight: str | None = None) -> str:
    """The tree, unrolled level by level."""
    w = weight or "1"
    parts = [f"k0 as (select node_id, lat, lon, {w} as w, '' as slice, '' as path from road_nodes)"]
    for i in range(depth):
        axis = ("lat", "lon")[i % 2]
        mid = "min(case when run >= half and r > 0 then r end) over (partition by slice)" if weight else "count(*) over (partition by slice) // 2"
        parts += [
            f"q{i} as (select *, row_number() over (partition by slice order by {axis}, node_id) - 1 as r, sum(w) over (partition by slice order by {axis}, node_id rows unbounded preceding) as run, sum(w) over (partition by slice) // 2 as half from k{i})",
            f"m{i} as (select *, {mid} as mid from q{i})",
            f"s{i} as (select slice as sp, {axis} as split from m{i} where r = mid)",
            f"k{i + 1} as (select node_id, lat, lon, w, slice || case when r < mid then '0' else '1' end as slice, path || case when {axis} < split then '0' else '1' end as path from m{i} join s{i} on sp = path)",
        ]
    return "with " + ",\n".join(parts) + f",\nregs as (select node_id, path, cast(dense_rank() over (order by path) - 1 as bigint) as region_id from k{depth})"


@query("kd_regions", kd_sql(3) + " select node_id, path, region_id from regs")
def _(fx):
    return regions.kd_regions(fx["road_nodes"], 3)


@query("kd_regions_weighted", kd_sql(3, "trip_weight") + " select node_id, path, region_id from regs")
def _(fx):
    return regions.kd_regions(fx["road_nodes"], 3, "trip_weight")


@query("region_boundary", kd_sql(2) + ", c as (select l.*, a.region_id as ra, b.region_id as rb from road_links_raw l join regs a on a.node_id = begin_node_id join regs b on b.node_id = end_node_id) select begin_node_id as node_id, ra as region_id from c where ra <> rb union select end_node_id, rb from c where ra <> rb")
def _(fx):
    return regions.boundary(fx["road_links_raw"], regions.kd_regions(fx["road_nodes"], 2))


@query("tree_height", kd_sql(3) + " select cast(min(length(path)) as bigint) as height from regs")
def _(fx):
    return regions.tree_height(regions.kd_regions(fx["road_nodes"], 3))


@query("region_of_point", kd_sql(3) + " select node_id as point_id, region_id from regs")
def _(fx):
    """The nodes' own coordinates as points: each lies in its node's region."""
    points = fx["road_nodes"].select(F.col("node_id").alias("point_id"), "lat", "lon")
    return regions.region_of(points, fx["road_nodes"], 3).select("point_id", "region_id")


@query("boundary_numbers", kd_sql(2) + ", c as (select l.*, a.region_id as ra, b.region_id as rb from road_links_raw l join regs a on a.node_id = begin_node_id join regs b on b.node_id = end_node_id), n as (select begin_node_id as node_id, ra as region_id from c where ra <> rb union select end_node_id, rb from c where ra <> rb) select node_id, region_id, row_number() over (partition by region_id order by node_id) - 1 as number from n")
def _(fx):
    return regions.number_boundary(regions.boundary(fx["road_links_raw"], regions.kd_regions(fx["road_nodes"], 2)))


GRID = "(select node_id, lat, lon, cast(floor((lon - w) / (e - w) * 20) * 20 + floor((lat - s) / (n - s) * 20) as bigint) as region_id from road_nodes, (select min(lat) as s, max(lat) + 0.01e0 as n, min(lon) as w, max(lon) + 0.01e0 as e from road_nodes) x)"


@query("grid_regions", f"select node_id, region_id from {GRID} g")
def _(fx):
    return regions.grid_regions(fx["road_nodes"])


@query("region_medians", f"select region_id, round(median(lat), 6) as lat, round(median(lon), 6) as lon from {GRID} g group by region_id")
def _(fx):
    g = fx["road_nodes"].join(regions.grid_regions(fx["road_nodes"]), "node_id")
    return g.groupBy("region_id").agg(r6(F.median("lat")).alias("lat"), r6(F.median("lon")).alias("lon"))


@query("westmost_region", f"select region_id from (select region_id, avg(lon) as m from {GRID} g group by region_id) order by m, region_id limit 1")
def _(fx):
    return west(fx)


def west(fx):
    g = fx["road_nodes"].join(regions.grid_regions(fx["road_nodes"]), "node_id")
    return g.groupBy("region_id").agg(F.avg("lon").alias("m")).agg(F.min_by("region_id", F.struct("m", "region_id")).alias("region_id"))


@query("drop_westmost", f"with g as (select * from {GRID} g0), w as (select region_id from (select region_id, avg(lon) as m from g group by region_id) order by m, region_id limit 1), k as (select node_id from g where region_id not in (select region_id from w)) select begin_node_id, end_node_id, street_length, cast(row_number() over (order by begin_node_id, end_node_id) - 1 as bigint) as link_id from road_links_raw where begin_node_id in (select * from k) and end_node_id in (select * from k)")
def _(fx):
    gone = regions.grid_regions(fx["road_nodes"]).join(F.broadcast(west(fx)), "region_id")
    return network.delete_nodes(fx["road_nodes"], fx["road_links_raw"], gone)[1]


@query("cluster_rows", f"select cast(4 as int) as k, cast(3 as int) as imbalance, lat, lon, region_id as region from {GRID} g")
def _(fx):
    g = fx["road_nodes"].join(regions.grid_regions(fx["road_nodes"]), "node_id")
    return g.select(F.lit(4).alias("k"), F.lit(3).alias("imbalance"), "lat", "lon", F.col("region_id").alias("region"))


@query("region_colors")
def _(fx):
    g = fx["road_nodes"].join(regions.grid_regions(fx["road_nodes"]), "node_id")
    ids = g.select("region_id").distinct()
    ranked = ids.withColumn("color_id", F.dense_rank().over(W.orderBy(F.xxhash64("region_id"), "region_id")).cast("long"))
    return g.join(F.broadcast(ranked), "region_id").select("node_id", "lat", "lon", "color_id")


@query("modularity", "with m as (select * from mini_links where a <> b), d as (select x % 8 as label, count(*) as d from (select a as x from m union all select b from m) y group by 1), t as (select count(*) as m, sum(cast(a % 8 = b % 8 as int)) as i from m) select round(i / cast(m as double) - (select sum(cast(d as double) * d) from d) / (4 * cast(m as double) * m), 6) as modularity from t")
def _(fx):
    m = fx["mini_links"].where("a <> b")
    labels = m.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node") % 8)
    return partition.modularity(m, labels).select(r6("modularity").alias("modularity"))


@query("spectral_clusters")
def _(fx):
    return partition.spectral_clusters(network.laplacian(network.adjacency(fx["road_links_raw"].select(*PAIR)), normalised=True), 4)


@query("modularity_road")
def _(fx):
    """modularity of the whole road graph; the SQL of modularity is bound to its small one."""
    und = network.undirected(fx["road_links_raw"])
    return partition.modularity(und, fx["road_nodes"].select(F.col("node_id").alias("node"), (F.col("node_id") % 8).alias("label")))


@query("balanced_partition")
def _(fx):
    und = network.undirected(fx["road_links_raw"])
    start = fx["road_nodes"].select(F.col("node_id").alias("node"), (F.col("node_id") % 4).alias("label"))
    return partition.balanced_partition(und, start, rounds=3)


# ---------------------------------------------------------------- graph

SSSP = """with recursive e as (select begin_node_id as u, end_node_id as v, street_length / 10 as w from road_links_raw),
r(node, cost) using key (node) as (select cast({src} as bigint), 0e0
 union select e.v, min(r.cost + e.w) from r join e on e.u = r.node left join recurring.r q on q.node = e.v
 where q.cost is null or r.cost + e.w < q.cost group by e.v)
"""


@query("sssp", SSSP.format(src=1) + "select node, round(cost, 6) as cost from r")
def _(fx):
    links = timed(fx).select(F.col(PAIR[0]).alias("u"), F.col(PAIR[1]).alias("v"), F.col("time").alias("w"))
    return graph.sssp(links, fx.spark.createDataFrame([(1,)], "source long")).select("node", r6("cost").alias("cost"))


@query("sssp_kernel", SSSP.format(src=1) + "select node, round(cost, 6) as cost from r")
def _(fx):
    g = routing.load_graph(timed(fx))
    return routing.trees(fx.spark.createDataFrame([(1,)], "source long"), g).select("node", r6("cost").alias("cost"))


CLOSE = """with recursive c(x, y) as (select a, b from mini_links where a <> b union select c.x, m.b from c join mini_links m on m.a = c.y where m.a <> m.b),
n as (select distinct node_id % 200 as node from road_nodes),
s as (select node, coalesce(min(least(f.y, node)), node) as component from n left join (select c.x, c.y from c join c d on d.x = c.y and d.y = c.x) f on f.x = node group by node)
"""


def mini(fx):
    nodes = fx["road_nodes"].select((F.col("node_id") % 200).alias("node")).distinct()
    return graph.strong_components(fx["mini_links"].select(F.col("a").alias("u"), F.col("b").alias("v")), nodes)


def whole(fx):
    """Components of the whole road graph; the SQL closure of scc would be too slow there."""
    links = fx["road_links_raw"].select(F.col(PAIR[0]).alias("u"), F.col(PAIR[1]).alias("v"))
    return graph.strong_components(links, fx["road_nodes"].select(F.col("node_id").alias("node")))


def small(c):
    return c.join(c.groupBy("component").agg(F.count("*").alias("n")).where("n < 5"), "component").select("component", "node", "n")


@query("scc_road")
def _(fx):
    return whole(fx)


@query("largest_scc_road")
def _(fx):
    return graph.largest_component(whole(fx))


@query("small_scc_rows_road")
def _(fx):
    return small(whole(fx))


@query("scc", CLOSE + "select node, component from s")
def _(fx):
    return mini(fx)


@query("largest_scc", CLOSE + ", z as (select component, count(*) as n from s group by 1 order by n desc, component limit 1) select node from s where component in (select component from z)")
def _(fx):
    return graph.largest_component(mini(fx))


@query("small_scc_rows", CLOSE + ", z as (select component, count(*) as n from s group by 1) select component, node, n from s join z using (component) where n < 5")
def _(fx):
    return small(mini(fx))


def od_pairs(fx):
    """A trip from every node, the same for every router."""
    n = F.col("node_id")
    return fx["road_nodes"].select(n.alias("trip_id"), n.alias("origin"), ((n * 37) % 200 + 1).alias("dest"))


def od_whole(fx):
    """A trip from every node; destinations range over all nodes."""
    ends = fx["road_nodes"].agg(F.min("node_id").alias("low"), F.max("node_id").alias("high"))
    n, low = F.col("node_id"), F.col("low")
    to = fx["road_nodes"].crossJoin(F.broadcast(ends))
    to = to.select(n.alias("trip_id"), n.alias("origin"), (n * 7919 % (F.col("high") - low + 1) + low).alias("dest"))
    return to.join(fx["road_nodes"].select(n.alias("dest")), "dest", "left_semi").select("trip_id", "origin", "dest")


#: Costs of all pairs' routes, from shortest-path trees towards their destinations.
OD = """with recursive e as (select begin_node_id as v, end_node_id as u, street_length / 10 as w from road_links),
od as (select node_id as trip_id, node_id as origin, (node_id * 37) % 200 + 1 as dest from road_nodes),
r(src, node, cost) using key (src, node) as (select distinct dest, dest, 0e0 from od
 union select r.src, e.v, min(r.cost + e.w) from r join e on e.u = r.node left join recurring.r q on q.node = e.v and q.src = r.src
 where q.cost is null or r.cost + e.w < q.cost group by r.src, e.v)
select trip_id, origin, dest, round(cost, 4) as cost from od left join r on r.src = dest and r.node = origin"""


def road_graph(fx):
    return routing.load_graph(timed(fx, "road_links"), fx["road_nodes"])


def costs(df):
    return df.select("trip_id", "origin", "dest", F.round("cost", 4).alias("cost"))


@query("route_trips", OD)
def _(fx):
    return costs(routing.route_trips(od_pairs(fx), road_graph(fx), paths=False))


@query("route_astar_cost", OD)
def _(fx):
    return costs(routing.route_trips(od_pairs(fx), road_graph(fx), goal=True, paths=False))


#: Splits of the region tree of arc flags: 128 regions, which the reference's region_size of 250 comes to.
REGION_DEPTH = 7


def flag_regions(fx):
    return regions.kd_regions(fx["road_nodes"], REGION_DEPTH).select("node_id", "region_id")


def flagged(fx):
    g, r = road_graph(fx), flag_regions(fx).persist(StorageLevel.MEMORY_AND_DISK)
    return g, routing.flag_matrix(g, routing.packed_flags(g, r), r)


@query("route_arcflags_cost", OD)
def _(fx):
    g, f = flagged(fx)
    return costs(routing.route_trips(od_pairs(fx), g, flags=f, paths=False))


@query("route_arcflags_astar_cost", OD)
def _(fx):
    g, f = flagged(fx)
    return costs(routing.route_trips(od_pairs(fx), g, goal=True, flags=f, paths=False))


@query("route_trips_road")
def _(fx):
    return costs(routing.route_trips(od_whole(fx), road_graph(fx), paths=False))


@query("route_astar_cost_road")
def _(fx):
    return costs(routing.route_trips(od_whole(fx), road_graph(fx), goal=True, paths=False))


@query("route_arcflags_cost_road")
def _(fx):
    g, f = flagged(fx)
    return costs(routing.route_trips(od_whole(fx), g, flags=f, paths=False))


@query("route_arcflags_astar_cost_road")
def _(fx):
    g, f = flagged(fx)
    return costs(routing.route_trips(od_whole(fx), g, goal=True, flags=f, paths=False))


@query("arcflags")
def _(fx):
    return routing.arc_flags(road_graph(fx), flag_regions(fx))


@query("boundary_labels")
def _(fx):
    g, r = road_graph(fx), regions.kd_regions(fx["road_nodes"], 1).select("node_id", "region_id")
    b = regions.boundary(fx["road_links"], r).select(F.col("node_id").alias("source"))
    to = routing.trees(b, g, reverse=True).withColumn("direction", F.lit("to"))
    return to.union(routing.trees(b, g).withColumn("direction", F.lit("from"))).withColumn("cost", r6("cost"))


@query("trip_links")
def _(fx):
    l = routing.path_links(routing.route_trips(od_whole(fx), road_graph(fx)))
    return network.with_nodes(l, fx["road_nodes"])


@query("route_coords")
def _(fx):
    t = nearest.match_trips(fx["trips"], fx["road_nodes"])
    return costs(routing.route_trips(t, road_graph(fx), goal=True, paths=False))


@query("knn_network", SSSP.format(src=1) + ", t as (select node, cost from r order by cost, node limit 10) select max(round(cost, 6)) as farthest, count(*) as n from t")
def _(fx):
    g = routing.load_graph(timed(fx))
    near = routing.trees(fx.spark.createDataFrame([(1,)], "source long"), g, most=10)
    return near.agg(F.max(r6("cost")).alias("farthest"), F.count("*").alias("n"))


@query("affinity")
def _(fx):
    g = routing.load_graph(timed(fx))
    near = routing.trees(fx["road_nodes"].select(F.col("node_id").alias("source")), g, most=8)
    return partition.affinity(near, 20.0).withColumn("v", r6("v"))


@query("path_diff_tags", "with a as (select begin_node_id as b, end_node_id as e, begin_node_id % 3 <> 0 as x, end_node_id % 3 <> 0 as y from road_links_raw) select b as begin_node_id, e as end_node_id, cast(case when x and y then 2 when x then 5 when y then -5 else 0 end as bigint) as tag from a")
def _(fx):
    """2: on both paths, 5: on the first only, -5: on the second only, 0: on none."""
    one, two = (fx["road_links_raw"].where(f"{c} % 3 <> 0") for c in PAIR)
    return labels.path_difference(fx["road_links_raw"], one, two).select(*PAIR, "tag")


# ---------------------------------------------------------------- estimation

PRED = """pr as (select p.trip_id, sum(l.street_length / 10) as t, sum(l.street_length) as s, min(dist_m) as dist_m from path_links p join road_links_raw l using (begin_node_id, end_node_id) group by 1),
ob as (select trip_id, k, true_time, t, case when s - dist_m < 100 then 1e0 else 0e0 end as w from path_times join pr using (trip_id))"""
SCHEME = ("abs", "threshold", 100.0)


def observed(fx):
    return est.observations(fx["path_links"], fx["path_times"], timed(fx), SCHEME)


@query("predict_trips", f"with {PRED} select trip_id, round(t, 6) as est_time, round(s, 6) as est_dist from pr")
def _(fx):
    p = est.predict(fx["path_links"], timed(fx))
    return p.select("trip_id", r6("est_time").alias("est_time"), r6("est_dist").alias("est_dist"))


@query("prediction_errors", f"with {PRED} select round(sum(abs(t - true_time) * w), 4) as total_error, round(avg(abs(t - true_time)), 6) as mean_abs, round(avg(abs(t - true_time) / true_time), 6) as mean_rel from ob")
def _(fx):
    e = est.prediction_errors(observed(fx))
    return e.select(F.round("total_error", 4).alias("total_error"), r6("mean_abs").alias("mean_abs"), r6("mean_rel").alias("mean_rel"))


OFF = f"{PRED}, pt as (select trip_id, sum(cast(sign(t - true_time) as double) * w) as o, sum(w) as n from ob group by 1), lo as (select begin_node_id, end_node_id, sum(o) as off, sum(n) as n from path_links join pt using (trip_id) group by 1, 2)"


@query("link_offsets", f"with {OFF} select begin_node_id, end_node_id, off + 0e0 as link_offset, n as num_trips from lo")
def _(fx):
    o = est.link_offsets(fx["path_links"], observed(fx))
    return o.select(*PAIR, (F.col("offset") + F.lit(0.0)).alias("link_offset"), "num_trips")


@query("proposed_times", f"with {OFF} select begin_node_id, end_node_id, round(greatest(case when off > 0 then l.street_length / 10 / 1.2e0 when off < 0 then l.street_length / 10 * 1.2e0 else l.street_length / 10 end, l.street_length / 30), 6) as proposed from lo join road_links_raw l using (begin_node_id, end_node_id)")
def _(fx):
    o = est.link_offsets(fx["path_links"], observed(fx)).select(*PAIR, "offset")
    j = o.join(timed(fx), PAIR)
    return j.select(*PAIR, r6(est.proposal(F.col("offset"), F.col("time"), F.col("street_length"), F.lit(0.2))).alias("proposed"))


@query(
    "step_search",
    """with recursive st(i, eps) as (select cast(0 as bigint), 0.2e0 union all select i + 1, eps * 0.75e0 from st where eps * 0.75e0 > 0.0001e0),
pr as (select p.trip_id, sum(l.street_length / 10) as t from path_links p join road_links_raw l using (begin_node_id, end_node_id) group by 1),
ob as (select trip_id, k, true_time, t from path_times join pr using (trip_id)),
pt as (select trip_id, sum(cast(sign(t - true_time) as double)) as o from ob group by 1),
lo as (select begin_node_id, end_node_id, sum(o) as off from path_links join pt using (trip_id) group by 1, 2),
pp as (select begin_node_id, end_node_id, i, eps, greatest(case when off > 0 then street_length / 10 / (1 + eps) when off < 0 then street_length / 10 * (1 + eps) else street_length / 10 end, street_length / 30) as p
  from lo join road_links_raw using (begin_node_id, end_node_id) cross join st),
es as (select trip_id, i, eps, sum(p) as e from path_links join pp using (begin_node_id, end_node_id) group by 1, 2, 3),
er as (select i, eps, sum(abs(e - true_time)) as error from es join path_times using (trip_id) group by 1, 2),
nw as (select sum(abs(t - true_time)) as now from ob)
select i as step_no, round(eps, 6) as step, round(error, 4) as error, coalesce(i = (select min(i) from er, nw where error < now), false) as accepted from er""",
)
def _(fx):
    s = est.step_search(fx["path_links"], fx["path_times"], timed(fx))
    return s.select("step_no", r6("step").alias("step"), F.round("error", 4).alias("error"), "accepted")


FOLD = "(select trip_id, row_number() over (order by md5('0:' || cast(trip_id as varchar)), trip_id) - 1 as at0, count(*) over () as n from trips)"


@query("cv_folds", f"select trip_id, cast(f as bigint) as fold from {FOLD} x join range(8) r(f) on at0 >= n * f // 8 and at0 < n * (f + 1) // 8")
def _(fx):
    return est.folds(fx["trips"].select("trip_id"), 8).select("trip_id", "fold")


@query("downsample_slices", f"select s as share, count(*) as n, min(at0) as first from {FOLD} x join (values (0.1e0), (0.5e0), (1e0)) t(s) on at0 < floor(n * s) group by s")
def _(fx):
    f = est.folds(fx["trips"].select("trip_id"), 8)
    n = f.agg(F.count("*").alias("n"))
    s = fx.spark.createDataFrame([(0.1,), (0.5,), (1.0,)], "share double").crossJoin(F.broadcast(n)).withColumn("limit", F.floor(F.col("n") * F.col("share"))).drop("n")
    return f.join(F.broadcast(s), F.col("at") < F.col("limit")).groupBy("share").agg(F.count("*").alias("n"), F.min("at").alias("first"))


LISTS = "(select user_id % 6 as list, row_number() over (partition by user_id % 6 order by trip_id) - 1 as pos, cast(duration_s as double) as x from trips)"


@query("avg_lists", f"select pos, round(avg(x), 6) as mean from {LISTS} l group by pos")
def _(fx):
    t = fx["trips"].withColumn("list", F.col("user_id") % 6)
    arrays = t.groupBy("list").agg(F.transform(F.sort_array(F.collect_list(F.struct("trip_id", "duration_s"))), lambda x: x["duration_s"]).alias("v"))
    long = arrays.select("list", F.posexplode("v").alias("pos", "x"))
    return est.ragged_mean(long, [], "pos", ["x"]).select(F.col("pos").cast("long").alias("pos"), r6("x").alias("mean"))


@query("learning_curve_avg", "select 100 * (1 + user_id % 3) as size, round(avg(duration_s), 6) as err from trips group by 1")
def _(fx):
    c = fx["trips"].select((100 * (1 + F.col("user_id") % 3)).alias("size"), F.col("duration_s").alias("err"))
    return est.ragged_mean(c, [], "size", ["err"]).select("size", r6("err").alias("err"))


def collapsed_by(fx, key, where="true"):
    """Valid trips matched to nodes and collapsed per key, with the mean speed over all valid trips of the key."""
    valid = fx["trips"].where(trip.validity() == 0).where(where)
    t = nearest.match_trips(valid, fx["road_nodes"]).where("origin is not null and dest is not null")
    c = t.groupBy(key.alias("slice"), "origin", "dest").agg(
        F.min_by("dist_m", "trip_id").alias("dist_m"), F.collect_list("duration_s").alias("dup_times"), F.min("trip_id").alias("trip_id")
    )
    speeds = valid.groupBy(key.alias("slice")).agg((F.sum("dist_m") / F.nullif(F.sum("duration_s").cast("double"), F.lit(0.0))).alias("mean_speed"))
    return c.join(speeds, "slice")


#: Rounds of the estimation loop unless it stops by itself, as the reference runs it.
MAX_ITER = 20
#: Shares of the training set in the learning curve: 18 sizes.
LEARNING_SIZES = [k / 18 for k in range(1, 19)]


def rounded_estimates(df):
    return df.select("slice", *PAIR, F.round("time", 4).alias("time"), F.round("num_trips", 4).alias("num_trips"), F.round("mean_abs_first", 4).alias("mean_abs_first"), F.round("mean_abs_last", 4).alias("mean_abs_last"), "error")


@query("estimate")
def _(fx):
    return rounded_estimates(est.estimate_by(collapsed_by(fx, F.lit("all")), "slice", road_graph(fx), max_iter=MAX_ITER))


@query("estimate_hourly")
def _(fx):
    return rounded_estimates(est.estimate_by(collapsed_by(fx, F.date_format("pickup_datetime", "HH")), "slice", road_graph(fx), max_iter=MAX_ITER)).where("num_trips > 0 or error is not null")


@query("estimate_relative")
def _(fx):
    return rounded_estimates(est.estimate_by(collapsed_by(fx, F.lit("all")), "slice", road_graph(fx), max_iter=MAX_ITER, relative=True))


def matched_folds(fx, k):
    t = nearest.match_trips(fx["trips"].where(trip.validity() == 0), fx["road_nodes"]).where("origin is not null and dest is not null")
    return est.folds(t, k)


@query("cv_errors")
def _(fx):
    cv = est.cross_validate(matched_folds(fx, 4), road_graph(fx), 4, MAX_ITER)
    return est.ragged_mean(cv, [], "iteration", ["train_abs", "test_abs", "train_rel", "test_rel"])


@query("learning_curve")
def _(fx):
    cv = est.cross_validate(matched_folds(fx, 2), road_graph(fx), 2, MAX_ITER, sizes=LEARNING_SIZES)
    last = cv.groupBy("variant", "fold").agg(F.max_by(F.struct("train_abs", "test_abs"), "iteration").alias("e"))
    return last.groupBy("variant").agg(F.avg("e.train_abs").alias("train_abs"), F.avg("e.test_abs").alias("test_abs"))


@query("kernel_sweep")
def _(fx):
    schemes = {"abs gauss 800": ("abs", "gauss", 800.0), "rel lasso 0.5": ("rel", "lasso", 0.5), "abs threshold 800": ("abs", "threshold", 800.0)}
    cv = est.cross_validate(matched_folds(fx, 2), road_graph(fx), 2, MAX_ITER, schemes=schemes)
    return est.ragged_mean(cv, ["variant"], "iteration", ["train_abs", "test_abs"])


@query("impute_streets")
def _(fx):
    s = snapped(fx).where("num_trips >= 3").withColumn("speed", F.col("street_length") / F.col("time"))
    return legacy.impute_streets(fx["road_links_raw"], s).withColumn("speed", r6("speed"))


@query("dispatch_sim")
def _(fx):
    p = F.col("pickup_datetime")
    t = fx["trips"].where(trip.validity() == 0).withColumns(
        {"day": F.date_format(p, "yyyy-MM-dd"), "second": (F.hour(p) * 3600 + F.minute(p) * 60 + F.second(p)).cast("double")}
    )
    return legacy.dispatch(t).withColumn("wait_s", r6("wait_s"))


def flagship(fx: Fixtures) -> DataFrame:
    """Links by the trips routed over them at mean speed, and how far their times are off."""
    t = fx["trips"].where(trip.validity() == 0)
    # Read by the router and by the join with its routes; matched once.
    c = nearest.collapse(nearest.match_trips(t, fx["road_nodes"])).persist(StorageLevel.MEMORY_AND_DISK)
    v = est.avg_velocity(t).first().velocity or 10.0
    links = fx["road_links"].withColumn("time", F.col("street_length") / v)
    routed = routing.route_trips(c, routing.load_graph(links, fx["road_nodes"]), goal=True)
    per = routed.join(c.select("trip_id", "dup_times", "num_occurrences"), "trip_id").where("cost is not null")
    off = F.aggregate("dup_times", F.lit(0.0), lambda s, x: s + F.abs(F.col("cost") - x))
    # The columns go with the links: a join with them would search all routes twice.
    steps = routing.path_links(per.select("trip_id", "path", off.alias("off"), "num_occurrences"), "off", "num_occurrences")
    return steps.groupBy(*PAIR).agg(
        F.sum("num_occurrences").alias("num_trips"), r6(F.sum("off") / F.sum("num_occurrences")).alias("mean_error_s")
    )


REGISTRY["street_usage"] = (flagship, None)


def queries() -> dict[str, Callable]:
    def bind(f):
        return lambda spark, sf_dir: f(Fixtures(spark, sf_dir))

    return {name: bind(f) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
