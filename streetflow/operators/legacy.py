"""Operators of the earlier generation: street imputation and the taxi dispatch simulation."""

from __future__ import annotations

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from streetflow.functions import geo
from streetflow.operators.network import ENDS, adjacent_streets
from streetflow.plans.cut import cut


def impute_streets(links: DataFrame, speeds: DataFrame) -> DataFrame:
    """links with speed and round: unestimated streets get the mean speed of adjacent estimated ones, level by level.

    All streets of a round see the streets estimated before it. Streets that no round reaches get speed -1, round null.
    """
    known = cut(speeds.select(*ENDS, "speed", F.lit(0).cast("long").alias("round")))
    open_links = cut(links.select(*ENDS).join(known, ENDS, "left_anti"))
    number = 0
    while True:
        number += 1
        near = adjacent_streets(open_links, known).join(
            known.select(*(F.col(c).alias(f"adj_{c}") for c in ENDS), "speed"), [f"adj_{c}" for c in ENDS]
        )
        new = cut(near.groupBy(*ENDS).agg(F.avg("speed").alias("speed")).withColumn("round", F.lit(number).cast("long")))
        if new.isEmpty():
            return known.unionByName(
                open_links.select(*ENDS, F.lit(-1.0).alias("speed"), F.lit(None).cast("long").alias("round"))
            )
        known = cut(known.unionByName(new))
        open_links = cut(open_links.join(new, ENDS, "left_anti"))


EARLY, SPEED, RADIUS = 270, 20 * geo.MILE / 3600, 3 * geo.MILE


def dispatch(trips: DataFrame, day: str = "day", taxis: int = 20) -> DataFrame:
    """(day, trip_id, taxi, wait_s): each request takes the nearest free taxi within a radius; one task per day.

    A request comes 270 s before the pickup; a taxi drives to it at 20 miles an hour and stands where it let its last
    passenger out. taxi and wait_s are null if none is free in reach. Taxis start at the first pickups of the day.
    """
    columns = [day, "trip_id", "taxi", "wait_s"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["second", "trip_id"])
        y, x = pdf["from_lat"] * geo.LAT_METRES, pdf["from_lon"] * geo.LON_METRES
        start = list(zip(y, x))[:taxis]
        place, free = dict(enumerate(start)), set(range(len(start)))
        busy: list[tuple[float, int, tuple[float, float]]] = []
        rows = []
        for i, s, dur, a, b, c, d in zip(pdf["trip_id"], pdf["second"], pdf["duration_s"], y, x, pdf["to_lat"], pdf["to_lon"]):
            asked = s - EARLY
            while busy and busy[0][0] <= asked:
                _, k, at = heappop(busy)
                free.add(k)
                place[k] = at
            reach = sorted((((place[k][0] - a) ** 2 + (place[k][1] - b) ** 2) ** 0.5, k) for k in free)
            if not reach or reach[0][0] > RADIUS:
                rows.append((pdf[day].iloc[0], i, None, None))
                continue
            far, k = reach[0]
            there = max(s, asked + far / SPEED)
            free.discard(k)
            heappush(busy, (there + dur, k, (c * geo.LAT_METRES, d * geo.LON_METRES)))
            rows.append((pdf[day].iloc[0], i, k, there - s))
        return pd.DataFrame(rows, columns=columns).astype({"taxi": "Int64"})

    return trips.groupBy(day).applyInPandas(run, f"{day} string, trip_id long, taxi long, wait_s double")
