"""What is recorded beside stored tiles, and whether stored tiles may be used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sections of the metadata and the names in each.
SECTIONS = {
    "provenance": "sample_id image_path mask_path backend requested_backend spacing_at_level_0 mask_backend requested_mask_backend".split(),
    "slide": "dimensions base_spacing_um level_downsamples".split(),
    "tiling": "requested_tile_size_px requested_spacing_um read_level read_tile_size_px read_spacing_um tile_size_lv0 tolerance step_px_lv0 overlap min_tissue_fraction is_within_tolerance n_tiles".split(),
    "segmentation": "tissue_method requested_seg_downsample seg_downsample seg_level seg_spacing_um sthresh sthresh_up mthresh close sam2_checkpoint_path sam2_config_path mask_path ref_tile_size_px tissue_mask_tissue_value mask_level mask_spacing_um".split(),
    "filtering": "a_t a_h filter_white filter_black white_threshold black_threshold fraction_threshold filter_grayspace grayspace_saturation_threshold grayspace_fraction_threshold filter_blur blur_threshold qc_spacing_um".split(),
    "artifact": "coordinate_space tile_order annotation selection_strategy output_mode".split(),
}

#: What is compared, in this order, between a slide's settings and those stored with its tiles.
COMPARED = (
    "sample_id image_path mask_path spacing_at_level_0 backend mask_backend requested_spacing_um requested_tile_size_px overlap min_tissue_fraction tolerance requested_seg_downsample sthresh sthresh_up mthresh close "
    "tissue_method sam2_checkpoint_path sam2_config_path ref_tile_size_px a_t a_h filter_white filter_black white_threshold black_threshold fraction_threshold filter_grayspace grayspace_saturation_threshold "
    "grayspace_fraction_threshold filter_blur blur_threshold qc_spacing_um selection_strategy output_mode annotation"
).split()


def metadata(rows: DataFrame) -> Column:
    """One JSON text of all sections; a name that rows have no column for is null, and nulls are written."""
    known = set(rows.columns)
    value = lambda name: F.col(name).alias(name) if name in known else F.lit(None).cast("string").alias(name)
    sections = [F.struct(*map(value, names)).alias(section) for section, names in SECTIONS.items()]
    return F.to_json(F.struct(*sections), {"ignoreNullFields": "false"})


def applies(name: str, now: str, then: str) -> Column | None:
    """When a setting is compared at all: thresholds only where their filter is on, and the mask's or model's settings only where there is one."""
    on = lambda *filters: F.coalesce(F.greatest(*[F.col(f"{now}.filter_{x}") for x in filters]) if len(filters) > 1 else F.col(f"{now}.filter_{filters[0]}"), F.lit(False))
    model = F.lower(F.coalesce(F.col(f"{then}.tissue_method"), F.lit(""))) == "sam2"
    return {
        "mask_backend": F.col(f"{now}.mask_path").isNotNull(),
        "tissue_method": F.col(f"{then}.mask_path").isNull(),
        "sam2_checkpoint_path": model,
        "sam2_config_path": model,
        "white_threshold": on("white"),
        "black_threshold": on("black"),
        "fraction_threshold": on("white", "black"),
        "grayspace_saturation_threshold": on("grayspace"),
        "grayspace_fraction_threshold": on("grayspace"),
        "blur_threshold": on("blur"),
        "qc_spacing_um": on("white", "black", "grayspace", "blur"),
    }.get(name)


def first_mismatch(wanted: DataFrame, stored: DataFrame, key: str | tuple[str, ...] = "sample_id", also: tuple[str, ...] = ()) -> DataFrame:
    """wanted with first_mismatch: the first of COMPARED, and then of `also`, in which the stored settings differ, null-safe; new where nothing is stored, ok where all agree."""
    keys = (key,) if isinstance(key, str) else key
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"now.{k}") == F.col(f"then.{k}")
    both = wanted.alias("now").join(stored.withColumn("_there", F.lit(True)).alias("then"), same, "left")
    told = F.when(F.col("then._there").isNull(), F.lit("new"))
    for name in (*COMPARED, *also):
        differs = ~F.col(f"now.{name}").eqNullSafe(F.col(f"then.{name}"))
        when = applies(name, "now", "then")
        told = told.when(differs if when is None else when & differs, F.lit(name))
    return both.select("now.*", told.otherwise(F.lit("ok")).alias("first_mismatch"))


def reusable(slides: DataFrame, arrays: DataFrame, sidecars: DataFrame) -> DataFrame:
    """slides with found: none, reuse, or missing sidecar.  arrays: sample_id.  sidecars: sample_id, n_tiles.

    Coordinates without metadata are an error of the store, and so is metadata of a slide with tiles but without coordinates.
    """
    out = slides.join(arrays.select("sample_id", F.lit(True).alias("_a")), "sample_id", "left").join(sidecars.select("sample_id", "n_tiles", F.lit(True).alias("_m")), "sample_id", "left")
    a, m = F.col("_a").isNotNull(), F.col("_m").isNotNull()
    found = F.when(~a & ~m, F.lit("none")).when(m & (a | (F.coalesce("n_tiles", F.lit(-1)) == 0)), F.lit("reuse")).otherwise(F.lit("missing sidecar"))
    return out.withColumn("found", found).drop("_a", "_m", "n_tiles")
