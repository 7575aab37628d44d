"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "streetflow", cpus: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; an active session keeps its own static settings."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tables(spark: SparkSession, sf_dir: str, *names: str):
    """The named tables of one scale folder, in the order asked for."""
    frames = [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]
    return frames[0] if len(frames) == 1 else frames
