"""Arc flags as hex text, four flags a digit, and simple display scales."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DIGITS = "0123456789abcdef"


def to_hex(flags: Column) -> Column:
    """array<int> of 0 and 1 as hex digits, the first flag highest; the last group is filled with zeros."""
    padded = F.concat(flags, F.array_repeat(F.lit(0), F.pmod(-F.size(flags), F.lit(4)).cast("int")))
    groups = F.sequence(F.lit(0), (F.size(padded) / 4).cast("int") - 1)
    bit = lambda g, k: F.get(padded, g * 4 + k)
    digit = lambda g: F.substring(F.lit(DIGITS), bit(g, 0) * 8 + bit(g, 1) * 4 + bit(g, 2) * 2 + bit(g, 3) + 1, F.lit(1))
    return F.when(F.size(flags) == 0, F.lit("")).otherwise(F.array_join(F.transform(groups, digit), ""))


def from_hex(text: Column, count: int) -> Column:
    """array<int> of the first count flags."""
    places = F.sequence(F.lit(0), F.lit(count - 1))
    value = lambda p: F.instr(F.lit(DIGITS), F.substring(text, F.floor(p / 4).cast("int") + 1, F.lit(1))) - 1
    return F.transform(places, lambda p: F.floor(value(p) / F.pow(F.lit(2), 3 - p % 4)).cast("int") % 2)


def color_scale(value: Column, low: float, high: float) -> Column:
    """Place of value between low and high, held inside 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
