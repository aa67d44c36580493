"""Choosing a pyramid level for a resolution, and what to read there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.functions import geometry as g


def level_downsamples(pyramid: DataFrame) -> DataFrame:
    first = W.partitionBy("slide_id").orderBy("level")
    return pyramid.withColumn("downsample_x", F.first("width").over(first) / F.col("width")).withColumn("downsample_y", F.first("height").over(first) / F.col("height"))


def level_spacings(pyramid: DataFrame, slides: DataFrame) -> DataFrame:
    return level_downsamples(pyramid).join(slides.select("slide_id", "base_spacing_um"), "slide_id").withColumn("spacing_um", F.col("base_spacing_um") * F.col("downsample_x"))


def with_levels(slides: DataFrame, pyramid: DataFrame) -> DataFrame:
    """Each slide with its few levels as an array, so that any number of choices needs no further join."""
    levels = pyramid.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("level", "downsample_x", "spacing_um", "width", "height"))).alias("levels"))
    return slides.join(levels, "slide_id")


def select_by_downsample(requests: DataFrame) -> DataFrame:
    """requests: levels, requested (a downsample)."""
    return requests.withColumn("chosen_level", g.nearest(F.col("levels"), F.col("requested"), "downsample_x")["level"])


def select_by_spacing(requests: DataFrame) -> DataFrame:
    """requests: levels, requested (a spacing), tolerance.  Adds read_level, read_spacing_um and is_near."""
    chosen = g.choose_level(F.col("levels"), F.col("requested"), F.col("tolerance"))
    return requests.withColumn("_c", chosen).select("*", F.col("_c.level").alias("read_level"), F.col("_c.spacing_um").alias("read_spacing_um"), F.col("_c.is_near").alias("is_near")).drop("_c")


def mask_level(requests: DataFrame) -> DataFrame:
    """As select_by_spacing, without any tolerance."""
    return select_by_spacing(requests.withColumn("tolerance", F.lit(-1.0))).drop("tolerance", "is_near")


def with_policy(selected: DataFrame) -> DataFrame:
    """Images are never enlarged: upsample_violation says where that would happen; labels may be."""
    return selected.withColumn("upsample_violation", (F.col("requested") < F.col("base_spacing_um")) & ~F.col("is_near"))


def read_plan(selected: DataFrame, target_w: int, target_h: int) -> DataFrame:
    size = lambda t: g.resize_ratio(F.lit(float(t)), F.col("requested"), F.col("read_spacing_um"), F.col("is_near"))
    return selected.withColumn("read_w", size(target_w)).withColumn("read_h", size(target_h))


def qc_geometry(selected: DataFrame, tile_px: int, tile_spacing: float) -> DataFrame:
    """selected: by the QC spacing.  Sizes of a tile there and at the level that is read."""
    side = float(tile_px) * tile_spacing
    one = F.lit(1.0)
    return selected.withColumn("qc_px", g.whole(F.greatest(one, F.rint(F.lit(side) / F.col("requested"))))).withColumn("read_px", g.whole(F.greatest(one, F.rint(F.lit(side) / F.col("read_spacing_um")))))


def padded_bounds(reads: DataFrame) -> DataFrame:
    """reads: x, y (level 0), w, h, downsample_x, width, height.  The part of the read inside the level, and where it goes on the white canvas."""
    out = reads.withColumn("lx", g.whole(F.floor(F.col("x") / F.col("downsample_x")))).withColumn("ly", g.whole(F.floor(F.col("y") / F.col("downsample_x"))))
    clip = lambda low, size, edge: F.greatest(F.lit(0), F.least(F.col(low) + F.col(size), F.col(edge)) - F.greatest(F.col(low), F.lit(0)))
    out = out.withColumn("inside_w", g.whole(clip("lx", "w", "width"))).withColumn("inside_h", g.whole(clip("ly", "h", "height")))
    return out.withColumn("paste_x", g.whole(F.greatest(F.lit(0), -F.col("lx")))).withColumn("paste_y", g.whole(F.greatest(F.lit(0), -F.col("ly"))))


def resolve_spacing(slides: DataFrame) -> DataFrame:
    """slides: native_um, override_um.  The override wins; disagree marks those that differ by more than rounding."""
    usable = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))
    chosen = F.coalesce(usable("override_um"), usable("native_um"))
    differ = F.coalesce(F.abs(F.col("override_um") - F.col("native_um")) > 1e-12 * F.greatest(F.abs("override_um"), F.abs("native_um")), F.lit(False))
    return slides.withColumn("spacing_um", chosen).withColumn("disagree", differ).withColumn("missing", chosen.isNull())


def size_guard(pyramid: DataFrame, limit_px: int) -> DataFrame:
    return pyramid.withColumn("too_large", F.col("width") * F.col("height") > limit_px)
