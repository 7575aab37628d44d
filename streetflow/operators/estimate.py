"""Travel-time estimation: its steps as joins and aggregates, and the whole loop as a kernel per slice or fold."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window as W, functions as F

from streetflow.functions.trips import distance_weight
from streetflow.operators import kernels

PAIR = ["begin_node_id", "end_node_id"]
STEPS = 27
#: Partitions that loops are dealt to, so that few share one; pieces of the routes a core.
SPREAD, CHUNKS = 256, 4


def avg_velocity(trips: DataFrame) -> DataFrame:
    return trips.agg((F.sum("dist_m") / F.nullif(F.sum("duration_s").cast("double"), F.lit(0.0))).alias("velocity"))


def predict(paths: DataFrame, times: DataFrame) -> DataFrame:
    """(trip_id, est_time, est_dist) of given paths under link times (pair, time, street_length)."""
    return paths.join(times, PAIR).groupBy("trip_id").agg(F.sum("time").alias("est_time"), F.sum("street_length").alias("est_dist"))


def observations(paths: DataFrame, observed: DataFrame, times: DataFrame, scheme=None) -> DataFrame:
    """A row per observation: trip_id, k, true_time, est_time, weight."""
    guess = predict(paths, times).join(paths.groupBy("trip_id").agg(F.first("dist_m").alias("dist_m")), "trip_id")
    w = F.lit(1.0) if scheme is None else distance_weight(*scheme, F.col("dist_m"), F.col("est_dist"))
    return observed.join(guess.withColumn("weight", w), "trip_id")


def prediction_errors(obs: DataFrame) -> DataFrame:
    off = F.abs(F.col("est_time") - F.col("true_time"))
    return obs.agg(
        F.sum(off * F.col("weight")).alias("total_error"),
        F.avg(off).alias("mean_abs"),
        F.avg(off / F.nullif(F.col("true_time"), F.lit(0.0))).alias("mean_rel"),
    )


def link_offsets(paths: DataFrame, obs: DataFrame) -> DataFrame:
    """(pair, offset, num_trips): whether the trips over a link are estimated too long, and their weight.

    Observations are summed per trip before they meet the links of the paths.
    """
    per = obs.groupBy("trip_id").agg(
        F.sum(F.signum(F.col("est_time") - F.col("true_time")) * F.col("weight")).alias("s"), F.sum("weight").alias("n")
    )
    return paths.join(per, "trip_id").groupBy(*PAIR).agg(F.sum("s").alias("offset"), F.sum("n").alias("num_trips"))


def proposal(offset, time, length, step):
    """Link time after a step against its offset, not below what the top speed takes."""
    moved = F.when(offset > 0, time / (1 + step)).when(offset < 0, time * (1 + step)).otherwise(time)
    return F.greatest(moved, length / kernels.TOP_SPEED)


def step_search(paths: DataFrame, observed: DataFrame, times: DataFrame) -> DataFrame:
    """(step_no, step, error, accepted): the error of all candidate steps in one job; the largest that helps is accepted."""
    sizes, step = [], kernels.STEP
    while step > kernels.LEAST:
        sizes.append(step)
        step *= kernels.SHRINK
    obs = observations(paths, observed, times)
    off = link_offsets(paths, obs).select(*PAIR, "offset")
    # One row per link and per trip: the candidates are columns, so they multiply no rows before a shuffle.
    tried = [proposal(F.col("offset"), F.col("time"), F.col("street_length"), F.lit(x)).alias(f"p{k}") for k, x in enumerate(sizes)]
    trial = times.join(off, PAIR).select(*PAIR, *tried)
    guess = paths.join(trial, PAIR).groupBy("trip_id").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(len(sizes))))
    now = obs.agg(F.sum(F.abs(F.col("est_time") - F.col("true_time"))).alias("now"))
    error = observed.join(guess, "trip_id").agg(*(F.sum(F.abs(F.col(f"p{k}") - F.col("true_time"))).alias(f"e{k}") for k in range(len(sizes))))
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("step_no"), F.lit(x).alias("step"), F.col(f"e{k}").alias("error")) for k, x in enumerate(sizes)))
    told = error.crossJoin(F.broadcast(now)).select("now", F.explode(rows).alias("x")).select("now", "x.*").where("error is not null")
    first = F.min(F.when(F.col("error") < F.col("now"), F.col("step_no"))).over(W.partitionBy())
    return told.withColumn("first", first).select(
        "step_no", "step", "error", F.coalesce(F.col("step_no") == F.col("first"), F.lit(False)).alias("accepted")
    )


# ---------------------------------------------------------------- loops


def _observed(pdf: pd.DataFrame, g: kernels.Graph) -> kernels.Observed:
    found = [(g.at(int(o)), g.at(int(d))) for o, d in zip(pdf["origin"], pdf["dest"])]
    ok = [a is not None and b is not None for a, b in found]
    pdf = pdf[ok]
    found = [x for x, k in zip(found, ok) if k]
    return kernels.Observed([a for a, _ in found], [b for _, b in found], pdf["dist_m"], pdf["dup_times"])


def spread_router(spark, g: kernels.Graph):
    """A router for kernels.estimate on the driver: each round the trips are routed over all cores, and only paths come back."""
    sc = spark.sparkContext
    shared, number, dealt = sc.broadcast(g.raw()), uuid4().hex, {}

    def router(trips, time):
        if id(trips) not in dealt:
            size = max(1, -(-len(trips.n) // (CHUNKS * sc.defaultParallelism)))
            parts = [(a, trips.origin[a : a + size], trips.dest[a : a + size]) for a in range(0, len(trips.n), size)]
            # The trips are kept, so that no other object gets their id.
            dealt[id(trips)] = trips, sc.parallelize(parts, max(1, len(parts)))
        times = sc.broadcast(time)

        def run(part):
            first, origin, dest = part
            flat, of, failed = kernels.routes(kernels.cached_graph(number, shared.value), origin, dest, times.value)
            return flat.astype(np.int32), of + first, failed + first

        found = dealt[id(trips)][1].map(run).collect()
        times.destroy()
        join = lambda k: np.concatenate([np.empty(0, np.int64), *(x[k].astype(np.int64) for x in found)])
        return join(0), join(1), join(2)

    return router


def _loops_on_driver(spark, jobs: int) -> bool:
    """Fewer loops than cores leave cores idle if each runs in a task: then the driver runs them, and their routes are spread."""
    return jobs < spark.sparkContext.defaultParallelism


def estimate_by(collapsed: DataFrame, key: str, g: kernels.Graph, max_iter: int = 20, scheme=None, relative: bool = False) -> DataFrame:
    """(key, begin_node_id, end_node_id, time, num_trips, error): link times of every slice, estimated where it lies; those of
    fewer slices than there are cores by loops on the driver that spread the routes. Both are the same loop.

    A slice that fails gives one row with its error instead of ending the job. A column ``mean_speed`` of collapsed (metres
    a second, over all trips that the slice has, matched or not) is where the estimate starts.
    """
    spark = collapsed.sparkSession
    columns = [key, *PAIR, "time", "num_trips", "mean_abs_first", "mean_abs_last", "error"]

    def loop(pdf: pd.DataFrame, g: kernels.Graph, router=None) -> pd.DataFrame:
        name = pdf[key].iloc[0]
        try:
            start = pdf["mean_speed"].iloc[0] if "mean_speed" in pdf else None
            time, counts, train, _ = kernels.estimate(g, _observed(pdf, g), max_iter, scheme, relative=relative, speed=start, router=router)
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame([(name, None, None, None, None, None, None, str(e)[:200])], columns=columns)
        first, last = (train[0][0], train[-1][0]) if train else (None, None)
        return pd.DataFrame(
            {key: name, PAIR[0]: g.ids[g.u], PAIR[1]: g.ids[g.v], "time": time, "num_trips": counts,
             "mean_abs_first": first, "mean_abs_last": last, "error": None}
        )[columns]

    kind = dict(collapsed.dtypes)[key]
    schema = f"{key} {kind}, begin_node_id long, end_node_id long, time double, num_trips double, mean_abs_first double, mean_abs_last double, error string"
    few = spark.sparkContext.defaultParallelism
    # The trips are matched once: kept on the executors until it is known where the loops run.
    collapsed = collapsed.persist(StorageLevel.MEMORY_AND_DISK)
    if _loops_on_driver(spark, collapsed.select(key).distinct().limit(few).count()):
        rows, router = collapsed.toArrow().to_pandas(), spread_router(spark, g)
        collapsed.unpersist()
        done = [loop(pdf, g, router) for _, pdf in rows.groupby(key, dropna=False)]
        return _frame(spark, done, columns, schema)
    shared, number = spark.sparkContext.broadcast(g.raw()), uuid4().hex

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return loop(pdf, kernels.cached_graph(number, shared.value))

    return collapsed.repartition(SPREAD, key).groupBy(key).applyInPandas(run, schema)


def _frame(spark, parts: list[pd.DataFrame], columns: list[str], schema: str) -> DataFrame:
    """Rows of the driver as a DataFrame, through Arrow."""
    empty = spark.createDataFrame([], schema)
    if not parts:
        return empty
    tables = [pa.Table.from_pandas(p[columns], preserve_index=False) for p in parts]
    out = spark.createDataFrame(pa.concat_tables(tables, promote_options="permissive"))
    return out.select(*(F.col(f.name).cast(f.dataType) for f in empty.schema))


def folds(trips: DataFrame, k: int, key: str = "trip_id", seed: int = 0) -> DataFrame:
    """trips with fold: position in a seeded order, cut at floor(n * f / k)."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = trips.withColumn("__place", place).withColumn("__part", F.substring("__place", 1, 3))
    # The 4096 prefixes are counted; a row's position is the count of smaller ones plus its rank inside its own.
    sums = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy()).alias("n"))
    own = F.row_number().over(W.partitionBy("__part").orderBy("__place", key)) - 1
    placed = rows.withColumn("__own", own).join(F.broadcast(sums), "__part")
    placed = placed.withColumn("at", (F.col("__before") + F.col("__own")).cast("long")).drop("__place", "__part", "__own", "__before")
    # The fold f with floor(n f / k) <= at < floor(n (f + 1) / k).
    fold = F.floor((F.col("at") * k + k - 1) / F.col("n"))
    fold = F.when(F.floor(F.col("n") * fold / k) > F.col("at"), fold - 1).otherwise(fold)
    fold = F.when(F.floor(F.col("n") * (fold + 1) / k) <= F.col("at"), fold + 1).otherwise(fold)
    return placed.withColumn("fold", fold.cast("long")).drop("n")


def cross_validate(trips: DataFrame, g: kernels.Graph, k: int, max_iter: int, sizes: list[float] | None = None, schemes: dict | None = None) -> DataFrame:
    """(variant, fold, iteration, train_abs, test_abs, train_rel, test_rel): one task per fold and variant.

    trips: fold, at, origin, dest, dist_m, duration_s, matched to nodes. sizes: shares of the training set, one variant
    each (a learning curve, whose test errors are taken after the last iteration only). schemes: {name: weighting}, one
    variant each. Fewer loops than cores run on the driver, their routes spread.
    """
    spark = trips.sparkSession
    variants = [(f"size {s}", s, None) for s in sizes or []] + [(n, 1.0, n) for n in schemes or {}] or [("all", 1.0, None)]
    jobs = spark.createDataFrame([(v, float(s), n, f) for v, s, n in variants for f in range(k)], "variant string, share double, scheme string, test_fold long")
    named = schemes or {}
    shared, number = spark.sparkContext.broadcast((g.raw(), named)), uuid4().hex

    def loop(pdf: pd.DataFrame, job, g: kernels.Graph, named: dict, router=None) -> pd.DataFrame:
        def collapsed(part):
            rows = part.sort_values("at").groupby(["origin", "dest"], as_index=False).agg(dist_m=("dist_m", "first"), dup_times=("duration_s", list))
            return _observed(rows, g)

        test = pdf[pdf["fold"] == job["test_fold"]]
        train = pdf[pdf["fold"] != job["test_fold"]].sort_values("at")
        train = train.head(max(1, int(len(train) * job["share"])))
        seconds = float(train["duration_s"].sum())
        start = float(train["dist_m"].sum()) / seconds if seconds > 0 else None
        _, _, a, b = kernels.estimate(
            g, collapsed(train), max_iter, named.get(job["scheme"]), test=collapsed(test), speed=start, router=router, last_only=bool(sizes)
        )
        return pd.DataFrame(
            {"variant": job["variant"], "fold": job["test_fold"], "iteration": np.arange(len(a)),
             "train_abs": [x[0] for x in a], "test_abs": [x[0] for x in b], "train_rel": [x[1] for x in a], "test_rel": [x[1] for x in b]}
        )

    schema = "variant string, fold long, iteration long, train_abs double, test_abs double, train_rel double, test_rel double"
    columns = [x.split()[0] for x in schema.split(", ")]
    rows = trips.select("fold", "at", "origin", "dest", "dist_m", "duration_s")
    if _loops_on_driver(spark, len(variants) * k):
        pdf, router = rows.toArrow().to_pandas(), spread_router(spark, g)
        some = [{"variant": v, "share": s, "scheme": n, "test_fold": f} for v, s, n in variants for f in range(k)] if len(pdf) else []
        return _frame(spark, [loop(pdf, job, g, named, router) for job in some], columns, schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw, named = shared.value
        return loop(pdf, pdf.iloc[0], kernels.cached_graph(number, raw), named)

    wide = rows.crossJoin(F.broadcast(jobs)).repartition(SPREAD, "variant", "test_fold")
    return wide.groupBy("variant", "test_fold").applyInPandas(run, schema)


def ragged_mean(df: DataFrame, keys: list[str], position: str, values: list[str]) -> DataFrame:
    """Mean per position over the lists that reach it."""
    return df.groupBy(*keys, position).agg(*(F.avg(v).alias(v) for v in values))
