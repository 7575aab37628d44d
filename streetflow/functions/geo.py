"""Flat-earth geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Metres per degree, metres per mile, the city box (left, top, right, bottom).
LAT_METRES, LON_METRES, MILE = 111194.86461, 84253.1418965, 1609.34
CITY_BOX = (-74.05, 40.9, -73.85, 40.65)
AIRPORT_BOX = (-73.825207, 40.665305, -73.751907, 40.622843)


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line metres between two points."""
    y, x = (lat1 - lat2) * LAT_METRES, (lon1 - lon2) * LON_METRES
    return F.sqrt(y * y + x * x)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    left, top, right, bottom = box
    return (lon > left) & (lon < right) & (lat > bottom) & (lat < top)


def grid_cell(value: Column, low: float, high: float, cells: int) -> Column:
    """Index of the cell that holds value, among equal cells between low and high."""
    return F.floor((value - low) / (high - low) * cells)
