"""Tissue contours: which regions of a mask count, their boxes on the slide, and the mask inside each.

A contour is an 8-connected component of a mask, named by its first pixel; its
holes are the 4-connected pieces of background inside the raster that touch no
edge.  Rasters are keyed by `keys`: a slide, or a slide and an annotation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.operators import components as cc
from gridquarry.shared import stored

SLIDE = ("slide_w", "slide_h", "base_spacing_um", "read_spacing_um")


def detect(mask: DataFrame, slides: DataFrame, mask_w: int, mask_h: int, keys: tuple[str, ...] = cc.KEYS, ref_tile_px: int = 16, a_t: int = 4, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(contours, pixels).  slides: slide_id, slide_w, slide_h, base_spacing_um, read_spacing_um.

    contours: keys..., contour_id, area (net of holes, between pixel centres) and x0, y0, x1, y1
    (exclusive) on level 0; those of no area, or of at most a_t reference tiles, are left out.
    pixels: keys..., contour_id, mx, my, of the contours that stay.
    """
    labelled = stored(cc.components(mask, mask_w, block, keys, height=mask_h), "contours")
    sx, sy = F.col("slide_w") / F.lit(mask_w), F.col("slide_h") / F.lit(mask_h)
    tile = F.lit(ref_tile_px) * (F.col("read_spacing_um") / F.col("base_spacing_um"))
    least = F.lit(a_t) * F.floor((tile / sx) * (tile / sy))
    low, high = (lambda c, s: F.floor(F.col(c) * s).cast("bigint")), (lambda c, s, edge: F.least(F.floor(F.col(c) * s).cast("bigint") + 1, F.col(edge)))
    boxes = cc.areas(labelled, keys).drop("area").join(cc.traced_areas(labelled, keys), [*keys, "component"]).join(slides.select("slide_id", *SLIDE), "slide_id")
    boxes = boxes.where((F.col("area") > 0) & (F.col("area") > (least if a_t > 0 else F.lit(0))))
    placed = (low("x0", sx).alias("x0"), low("y0", sy).alias("y0"), high("x1", sx, "slide_w").alias("x1"), high("y1", sy, "slide_h").alias("y1"))
    found = stored(boxes.select(*keys, F.col("component").alias("contour_id"), "area", *placed), "boxes")
    pixels = labelled.withColumnRenamed("component", "contour_id").join(found.select(*keys, "contour_id"), [*keys, "contour_id"], "left_semi")
    return found, pixels


def inner_mask(pixels: DataFrame, mask: DataFrame, rasters: DataFrame, mask_w: int, mask_h: int, keys: tuple[str, ...] = cc.KEYS, block: int | None = None) -> DataFrame:
    """The pixels that count as tissue of their contour: without the rims of its holes, which are drawn as part of the holes.  rasters: the keys of all rasters."""
    hole = cc.holes(mask, rasters, mask_w, mask_h, keys, 4, block).select(*keys, "mx", "my")
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    rim = hole.withColumn("_d", around).select(*keys, (F.col("mx") + F.col("_d.dx")).alias("mx"), (F.col("my") + F.col("_d.dy")).alias("my"))
    return pixels.join(rim, [*keys, "mx", "my"], "left_anti")


def net_area(pixels: DataFrame, keys: tuple[str, ...] = cc.KEYS) -> DataFrame:
    return cc.traced_areas(pixels.withColumnRenamed("contour_id", "component"), keys).withColumnRenamed("component", "contour_id")
