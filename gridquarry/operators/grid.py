"""Tile grids: candidates, first-wins deduplication, dense indices, strides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def candidates(boxes: DataFrame, tile: int, step: int, keep: tuple[str, ...] = ("slide_id",)) -> DataFrame:
    """boxes: keep..., x0, y0, x1, y1 (exclusive).  Origins from the box's corner on; a tile may hang over the edge."""
    inside = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    along = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b) - 1, F.lit(step).cast("bigint")))
    columns = boxes.where(inside).withColumn("x", along("x0", "x1"))
    return columns.withColumn("y", along("y0", "y1")).select(*keep, "x", "y", F.lit(tile).cast("bigint").alias("tile"))


def slide_boxes(slides: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return slides.select("slide_id", "slide_w", "slide_h", zero.alias("x0"), zero.alias("y0"), F.col("slide_w").alias("x1"), F.col("slide_h").alias("y1"))


def dedup_first(tiles: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of tiles with equal keys the first in order; minima are combined before the shuffle, so no key's rows meet in one task."""
    rest = [c for c in tiles.columns if c not in keys and c not in order]
    first = tiles.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*keys, *(F.col(f"_f.{c}").alias(c) for c in [*order, *rest])).select(tiles.columns)


def indexed(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Dense tile_index from 0 in x-then-y order.

    Columns of tiles are numbered by (key, x) first: a window over the few distinct x of a key
    gives each column's offset, and a window inside the column does the rest, so that a slide of
    any size is not sorted in one task.
    """
    per_x = tiles.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    offset = per_x.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*keys, "x").orderBy("y")) - 1
    out = tiles.withColumn("_i", inside)
    return out.join(offset, [*keys, "x"]).withColumn("tile_index", (F.col("_before") + F.col("_i")).cast("int")).drop("_before", "_i")


def limited(tiles: DataFrame, n: int) -> DataFrame:
    return tiles if n <= 0 else tiles.where(F.col("tile_index") < n)


def stride(tiles: DataFrame, key: str, fallback: int) -> DataFrame:
    """Smallest positive gap between distinct x, else between distinct y, else the fallback."""

    def gaps(c: str) -> DataFrame:
        lag = F.lag(c).over(W.partitionBy(key).orderBy(c))
        return tiles.select(key, c).distinct().withColumn("_g", F.col(c) - lag).groupBy(key).agg(F.min("_g").alias(f"g{c}"))

    return gaps("x").join(gaps("y"), key).select(key, F.coalesce("gx", "gy", F.lit(fallback)).cast("bigint").alias("step"))


def contiguous(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Whether tile_index is 0..n-1, by key."""
    n = F.count(F.lit(1))
    return tiles.groupBy(*keys).agg(n.alias("num_tiles"), ((F.min("tile_index") == 0) & (F.max("tile_index") == n - 1) & (F.countDistinct("tile_index") == n)).alias("contiguous"))
