"""Column functions for coordinates, levels and sizes.

Rounding is half to even throughout; origins floor, sizes round.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(c: Column) -> Column:
    return c.cast("bigint")


def project_origin(c: Column, scale: Column) -> Column:
    return whole(F.floor(c * scale))


def project_size(size: Column, scale: Column) -> Column:
    return whole(F.greatest(F.lit(1.0), F.rint(size * scale)))


def tile_footprint(read_px: Column, read_spacing: Column, base_spacing: Column) -> Column:
    """Level-0 side of a tile that is read with read_px pixels."""
    return whole(F.rint(read_px * read_spacing / base_spacing))


def tile_step(size: Column, overlap: Column) -> Column:
    return whole(F.greatest(F.lit(1.0), F.rint(size * (F.lit(1.0) - overlap))))


def resize_ratio(target: Column, requested: Column, read: Column, is_near: Column) -> Column:
    """Pixels to read for a target size: the target itself when the level is close enough."""
    return F.when(is_near, whole(target)).otherwise(whole(F.rint(target * (requested / read))))


def pixels_of_area(um2: Column, spacing: Column) -> Column:
    return F.when(um2 <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1.0), F.rint(um2 / (spacing * spacing)))).cast("bigint")


def pixels_of_length(um: Column, spacing: Column) -> Column:
    return F.when(um <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1.0), F.rint(um / spacing))).cast("bigint")


def nearest(levels: Column, wanted: Column, field: str) -> Column:
    """The level struct whose `field` is nearest to `wanted`; of equally near ones the first level."""
    keyed = F.transform(levels, lambda v: F.struct(F.abs(v[field] - wanted).alias("off"), v["level"].alias("level"), v["spacing_um"].alias("spacing_um")))
    return F.array_min(keyed)


def choose_level(levels: Column, wanted: Column, tolerance: Column) -> Column:
    """struct(level, spacing_um, is_near): the nearest level, or, where that is coarser than wanted beyond the tolerance, the next finer one that is not."""
    best = nearest(levels, wanted, "spacing_um")
    finer = F.array_max(F.transform(F.filter(levels, lambda v: (v["level"] < best["level"]) & (v["spacing_um"] <= wanted)), lambda v: v["level"]))
    keep = (best["off"] / wanted <= tolerance) | (best["spacing_um"] <= wanted)
    level = F.when(keep, best["level"]).otherwise(F.coalesce(finer, F.lit(0)))
    spacing = F.filter(levels, lambda v: v["level"] == level)[0]["spacing_um"]
    return F.struct(level.alias("level"), spacing.alias("spacing_um"), (F.abs(spacing - wanted) / wanted <= tolerance).alias("is_near"))
