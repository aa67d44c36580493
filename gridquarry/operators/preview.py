"""Geometry of previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rectangles(tiles: DataFrame, downsample: float, tile: int) -> DataFrame:
    """Each tile's rectangle on a preview: corners by ceiling, 1 pixel at least."""
    up = lambda c: F.ceil(c / F.lit(float(downsample))).cast("bigint")
    return tiles.select("slide_id", "tile_index", up(F.col("x")).alias("px"), up(F.col("y")).alias("py"), F.greatest(F.lit(1).cast("bigint"), up(F.lit(float(tile)))).alias("side"))


def padded_size(images: DataFrame, patch: int) -> DataFrame:
    """Sizes rounded up to whole patches."""
    pad = lambda c: (F.col(c) + F.pmod(-F.col(c), F.lit(patch))).cast("bigint")
    return images.withColumn("padded_w", pad("width")).withColumn("padded_h", pad("height"))


def stroke(levels: DataFrame, base: float = 64.0) -> DataFrame:
    return levels.withColumn("stroke", F.greatest(F.lit(1.0), F.rint(F.lit(base) / F.col("downsample_x"))).cast("int"))
