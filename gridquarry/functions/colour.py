"""Colour as exact integer formulas over 0..255 columns r, g and b."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _top(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b)


def value(r: Column, g: Column, b: Column) -> Column:
    return _top(r, g, b)


def saturation(r: Column, g: Column, b: Column) -> Column:
    """255 * (max - min) / max, rounded half up; 0 for black."""
    top = _top(r, g, b)
    spread = top - F.least(r, g, b)
    return F.when(top == 0, F.lit(0)).otherwise(F.floor((510 * spread + top) / (2 * top))).cast("int")


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees halved, 0..179, rounded half up; 0 for grey."""
    top = _top(r, g, b)
    spread = (top - F.least(r, g, b)).cast("double")
    degrees = F.when(top == r, 60.0 * (g - b) / spread).when(top == g, 120.0 + 60.0 * (b - r) / spread).otherwise(240.0 + 60.0 * (r - g) / spread)
    positive = F.when(degrees < 0, degrees + 360.0).otherwise(degrees)
    return F.when(spread == 0, F.lit(0)).otherwise(F.floor(positive / 2 + 0.5) % 180).cast("int")


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")
