"""Column names that no column of a frame has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def prefix(df: DataFrame) -> str:
    """A prefix of underscores that no column of df starts with."""
    out = "__"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out
