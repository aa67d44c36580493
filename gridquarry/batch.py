"""Runs over many slides: tiles, run table, resuming, and what went wrong.

Inputs are tables: a manifest (sample_id, image_path, mask_path,
spacing_at_level_0), the slides' pyramids (sample_id, level, width, height,
base_spacing_um) and their masks (sample_id, mx, my, and label for sampling by
annotation) on rasters of mask_w x mask_h.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry import archives, outcomes
from gridquarry.functions import names
from gridquarry.operators import levels, provenance, qc, runs, sampling, tiling
from gridquarry.shared import stored
from gridquarry.store import RunStore


class PartialFailure(UserWarning):
    """Some slides of a run failed; the others are there."""


def checked(manifest: DataFrame) -> DataFrame:
    """The manifest; a slide that is listed twice is an error."""
    twice = runs.duplicate_ids(manifest).limit(5).collect()
    if twice:
        raise ValueError(f"slides listed more than once: {[r['sample_id'] for r in twice]}")
    return manifest


def problems(manifest: DataFrame, pyramids: DataFrame, spec: tiling.Spec) -> DataFrame:
    """(sample_id, error): slides that cannot be tiled, with the reason."""
    base = pyramids.where("level = 0").select("sample_id", F.col("base_spacing_um").alias("_um"))
    um = F.coalesce("spacing_at_level_0", "_um")
    error = (
        F.when(F.col("_there").isNull(), F.concat(F.lit("cannot open "), F.coalesce("image_path", F.lit("a slide without a path"))))
        .when(um.isNull() | F.isnan(um) | (um <= 0), F.lit("the spacing of level 0 is not known"))
        .when(um * (1 - spec.tolerance) > spec.spacing_um, F.lit("images are not enlarged: finer than level 0"))
    )
    there = manifest.join(base.withColumn("_there", F.lit(True)), "sample_id", "left")
    return there.select("sample_id", error.alias("error")).where("error is not null")


@dataclass(frozen=True)
class Outcome:
    """What a run has made: tiles and status rows, the pairs (sample_id, annotation) that were worked on, and the slides' sizes and read plans."""

    tiles: DataFrame
    rows: DataFrame
    worked: DataFrame
    sized: DataFrame


def wanted_annotations(vocabulary: DataFrame | None, output: str) -> list[str]:
    if vocabulary is None:
        return ["tissue"]
    return ["merged"] if output == "merged" else sorted(tiling.active_labels(vocabulary))


def tile_slides(manifest: DataFrame, pyramids: DataFrame, masks: DataFrame, mask_w: int, mask_h: int, spec: tiling.Spec, vocabulary: DataFrame | None = None, strategy: str = "independent", output: str = "per_annotation", keep: DataFrame | None = None, errors: DataFrame | None = None, check: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Outcome:
    """Tiles by sample_id and annotation, and a status row for each, in the order of the manifest.

    keep: sample_id, annotation and n_tiles of results that stand; they get a row and are not
    worked on.  Where annotations share their grids (joint sampling, merged output), those of a
    slide stand together or not at all.  errors: sample_id and error of slides that are known to be
    broken.  check: from tiles (slide_id, annotation, ...) and slides to the tiles that pass.
    """
    listed = stored(checked(manifest).withColumn("row_id", F.monotonically_increasing_id()), "manifest")
    wanted = wanted_annotations(vocabulary, output)
    pairs = listed.select("sample_id").withColumn("annotation", F.explode(F.array(*[F.lit(a) for a in wanted])))
    kept = pairs.where(F.lit(False)).withColumn("n_tiles", F.lit(0)) if keep is None else keep.select("sample_id", "annotation", F.col("n_tiles").cast("int").alias("n_tiles")).join(pairs, ["sample_id", "annotation"], "left_semi")
    if vocabulary is not None and (strategy == "joint" or output == "merged"):
        kept = kept.join(kept.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)), "sample_id", "left_semi")
    kept = stored(kept, "kept")
    todo = stored(pairs.join(kept, ["sample_id", "annotation"], "left_anti"), "todo")
    own = listed.join(todo, "sample_id", "left_semi")
    known = problems(own, pyramids, spec) if errors is None else outcomes.first_errors(errors.join(own, "sample_id", "left_semi"), problems(own, pyramids, spec))
    bad = stored(known, "problems")
    good = own.join(bad, "sample_id", "left_anti").withColumn("slide_id", F.col("row_id"))
    slides, _, own_masks = _inputs(good, pyramids, masks)
    todo_ids = todo.join(good.select("sample_id", "slide_id"), "sample_id").select("slide_id", "annotation")
    if vocabulary is None:
        found = tiling.from_mask(own_masks.drop("label") if "label" in own_masks.columns else own_masks, slides, mask_w, mask_h, spec).withColumn("annotation", F.lit("tissue"))
    else:
        split = sampling.split(own_masks, vocabulary)
        if strategy == "independent" and output == "per_annotation":
            split = split.join(todo_ids, ["slide_id", "annotation"], "left_semi")
        found = tiling.per_annotation(split, slides, vocabulary, mask_w, mask_h, spec, strategy, output)
        found = found.withColumn("annotation", F.coalesce("annotation", F.lit("merged")))
    found = stored(found.select("slide_id", "annotation", "tile_index", "x", "y", "frac"), "found")
    if check is not None:
        found = check(found, slides.join(good.select("slide_id", "image_path"), "slide_id"))
    tiles = stored(found.join(good.select("slide_id", "sample_id"), "slide_id").select("sample_id", "annotation", "tile_index", "x", "y", "frac"), "tiles")
    counts = tiles.groupBy("sample_id", "annotation").agg(F.count(F.lit(1)).cast("int").alias("n"))
    went = todo.join(good.select("sample_id"), "sample_id", "left_semi").join(counts, ["sample_id", "annotation"], "left").select("sample_id", "annotation", F.coalesce("n", F.lit(0)).alias("num_tiles"), F.lit(None).cast("string").alias("error"))
    stood = kept.select("sample_id", "annotation", F.col("n_tiles").alias("num_tiles"), F.lit(None).cast("string").alias("error"))
    failed = bad.select("sample_id", F.lit(None).cast("string").alias("annotation"), F.lit(0).alias("num_tiles"), "error")
    rows = runs.process_rows(listed.select("sample_id", "image_path"), went.unionByName(stood).unionByName(failed))
    ordered = runs.input_order(rows, listed).drop("input_index").withColumnRenamed("out_index", "row_id")
    sized = tiling.geometry(slides, spec).join(good.select("slide_id", "sample_id"), "slide_id")
    return Outcome(tiles, stored(ordered, "rows"), todo, sized)


def _inputs(good: DataFrame, pyramids: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    masks = masks.select("sample_id", "mx", "my", *(["label"] if "label" in masks.columns else []))
    own = pyramids.select("sample_id", "level", "width", "height", "base_spacing_um").join(good.select("sample_id", "slide_id", "spacing_at_level_0"), "sample_id")
    base = own.where("level = 0").select("slide_id", F.col("width").alias("slide_w"), F.col("height").alias("slide_h"), F.coalesce("spacing_at_level_0", "base_spacing_um").alias("base_spacing_um"))
    pyramid = levels.level_spacings(own.select("slide_id", "level", "width", "height"), base)
    return levels.with_levels(base, pyramid), pyramid, masks.join(good.select("sample_id", "slide_id"), "sample_id").drop("sample_id")


def wanted_settings(manifest: DataFrame, spec: tiling.Spec, limits: qc.Limits | None, vocabulary: DataFrame | None, strategy: str, output: str, mask_size: tuple[int, int], backend: str, qc_spacing_um: float) -> DataFrame:
    """One row for each sample and annotation: all that is compared, and the mask's size and label, which tell results apart too."""
    limits = limits or NO_LIMITS
    lit, none = F.lit, lambda kind: F.lit(None).cast(kind)
    labels = None if vocabulary is None or output == "merged" else vocabulary.select("annotation", F.col("value").cast("string").alias("label"), F.coalesce(F.col("min_coverage"), F.lit(0.0)).cast("double").alias("least"))
    own = manifest.withColumn("annotation", F.explode(F.array(*[lit(a) for a in wanted_annotations(vocabulary, output)])))
    if labels is not None:
        own = own.join(F.broadcast(labels), "annotation")
    elif vocabulary is not None:
        told = sorted((r["annotation"], r["value"], r["min_coverage"]) for r in vocabulary.limit(257).collect())
        own = own.withColumn("label", lit(json.dumps(told))).withColumn("least", none("double"))
    else:
        own = own.withColumn("label", none("string")).withColumn("least", lit(spec.min_coverage))
    on = lambda share: lit(share is not None)
    number = lambda x: lit(x).cast("double")
    values = {
        "sample_id": F.col("sample_id"), "annotation": F.col("annotation"), "image_path": F.col("image_path"), "mask_path": F.col("mask_path"), "spacing_at_level_0": F.col("spacing_at_level_0"), "backend": lit(backend), "mask_backend": F.when(F.col("mask_path").isNotNull(), lit(backend)),
        "requested_spacing_um": number(spec.spacing_um), "requested_tile_size_px": lit(spec.tile_px), "overlap": number(spec.overlap), "min_tissue_fraction": F.col("least"), "tolerance": number(spec.tolerance),
        "requested_seg_downsample": none("int"), "sthresh": none("int"), "sthresh_up": none("int"), "mthresh": none("int"), "close": none("int"), "tissue_method": lit("precomputed"), "sam2_checkpoint_path": none("string"), "sam2_config_path": none("string"),
        "ref_tile_size_px": lit(spec.ref_tile_px), "a_t": lit(spec.a_t), "a_h": none("int"), "filter_white": on(limits.white_share), "filter_black": on(limits.black_share), "white_threshold": lit(limits.white_above), "black_threshold": lit(limits.black_below), "fraction_threshold": number(limits.white_share if limits.white_share is not None else limits.black_share),
        "filter_grayspace": on(limits.grey_share), "grayspace_saturation_threshold": number(limits.grey_below), "grayspace_fraction_threshold": number(limits.grey_share), "filter_blur": on(limits.blur_least), "blur_threshold": number(limits.blur_least), "qc_spacing_um": number(qc_spacing_um),
        "selection_strategy": lit(None if vocabulary is None else strategy).cast("string"), "output_mode": lit(None if vocabulary is None else output).cast("string"), "mask_size": lit(f"{mask_size[0]} x {mask_size[1]}"), "label": F.col("label"),
    }
    return own.select(*(c.alias(n) for n, c in values.items()))


NO_LIMITS = qc.Limits(white_share=None, black_share=None, grey_share=None, blur_least=None)


def _with_metadata(settings: DataFrame, outcome: Outcome) -> DataFrame:
    """Settings of the results that were made, with n_tiles and meta, the text that goes beside the arrays."""
    made = outcome.rows.where(F.col("tiling_status") == runs.SUCCESS).select("sample_id", "annotation", F.col("num_tiles").cast("bigint").alias("n_tiles"))
    own = settings.join(outcome.worked, ["sample_id", "annotation"], "left_semi").join(made, ["sample_id", "annotation"])
    size = outcome.sized.select(
        "sample_id", F.array("slide_w", "slide_h").alias("dimensions"), "base_spacing_um", F.transform("levels", lambda v: v["spacing_um"] / F.col("base_spacing_um")).alias("level_downsamples"), "read_level", F.col("read_px").alias("read_tile_size_px"), "read_spacing_um", F.col("tile").alias("tile_size_lv0"), F.col("step").alias("step_px_lv0"), F.col("is_near").alias("is_within_tolerance")
    )
    wide = own.join(size, "sample_id").withColumn("coordinate_space", F.lit("level_0")).withColumn("tile_order", F.lit("x_then_y"))
    return wide.withColumn("meta", provenance.metadata(wide)).select(*settings.columns, "n_tiles", "meta")


def run(spark: SparkSession, settings: dict) -> int:
    """A run as its settings say; the number of slides that failed.

    settings: manifest (CSV), out (folder), mask_size [w, h], tiling (fields of Spec), and
    optionally pyramids and masks (Parquet; without them the slides' and masks' files are opened on
    the executors), backend, labels ({annotation: [value, threshold or null]}), strategy, output,
    filtering (fields of Limits: quality control on pixels of the slides) with qc_spacing_um,
    save_tiles: true for tile archives (with resume also of results that stand), and resume: true,
    or a run table as CSV of a run into this folder.

    With resume, results whose settings agree with those stored stand as they are; the others,
    and those that failed, are made again, and slides that are not listed any more keep what they
    have.  Without it the folder's results are replaced.  Either way all changes hold at once.
    """
    from gridquarry.config import build, validate_labels
    from gridquarry.session import ship_package
    from gridquarry.sources import manifest as mf
    from gridquarry.sources import probing

    ship_package(spark)
    spec = tiling.Spec(**settings.get("tiling", {}))
    limits = build(qc.Limits, settings["filtering"]) if settings.get("filtering") else None
    backend, qc_um, size = settings.get("backend", "pil"), float(settings.get("qc_spacing_um", 2.0)), tuple(settings["mask_size"])
    strategy, output = settings.get("strategy", "independent"), settings.get("output", "per_annotation")
    vocabulary = None
    if told := settings.get("labels"):
        validate_labels({k: v[0] for k, v in told.items()})
        vocabulary = spark.createDataFrame([(k, int(v[0]), None if v[1] is None else float(v[1])) for k, v in told.items()], "annotation string, value int, min_coverage double")
    store = RunStore(spark, settings["out"])
    manifest = mf.slides(spark.read.option("header", True).csv(settings["manifest"]))
    given = {name: spark.read.parquet(settings[name]) if settings.get(name) else None for name in ("pyramids", "masks")}
    pyramids = given["pyramids"] if given["pyramids"] is not None else lambda slides: probing.pyramids(slides, backend)
    masks = given["masks"] if given["masks"] is not None else lambda slides: probing.masks(slides, backend, *size)
    config = {"config/part-0.txt": json.dumps(settings, sort_keys=True, default=str)}
    outcome = update(store, manifest, pyramids, masks, size, spec, vocabulary, strategy, output, limits, backend, qc_um, bool(settings.get("resume")), config)
    if settings.get("save_tiles"):
        saved = archives.save(store, outcome.worked if not settings.get("resume") else None)
        saved.coalesce(1).write.mode("overwrite").option("header", True).csv(store.at("archives"))
    told = runs.failed_slides(outcome.rows)
    n = told.count()
    if n:
        shown = "; ".join(f"{r['sample_id']}: {r['reasons']}" for r in told.orderBy("sample_id").limit(10).collect())
        warnings.warn(f"{n} slides failed ({shown})", PartialFailure, stacklevel=2)
    return n


#: A table, or what makes it from the slides that have to be opened, with (sample_id, error) of those that could not be.
Source = DataFrame | Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def update(store: RunStore, manifest: DataFrame, pyramids: Source, masks: Source, size: tuple[int, int], spec: tiling.Spec, vocabulary: DataFrame | None = None, strategy: str = "independent", output: str = "per_annotation", limits: qc.Limits | None = None, backend: str = "pil", qc_um: float = 2.0, resume: bool = True, texts: dict[str, str] | None = None) -> Outcome:
    """Bring a store to what is asked for: see `run`."""
    store.recover()
    manifest = stored(manifest, "listed")
    wanted = wanted_settings(manifest, spec, limits, vocabulary, strategy, output, size, backend, qc_um)
    keep = stored(store.standing(wanted).where("first_mismatch = 'ok'"), "standing") if resume else None
    todo = manifest if keep is None else manifest.join(wanted.join(keep, ["sample_id", "annotation"], "left_anti"), "sample_id", "left_semi")
    errors = []
    if callable(pyramids):
        pyramids, broken = pyramids(todo)
        errors.append(broken)
    if callable(masks):
        masks, broken = masks(todo)
        errors.append(broken)
    check = None
    if limits is not None and limits.needed():
        check = lambda tiles, slides: tiling.checked_tiles(tiles, slides.withColumn("backend", F.lit(backend)), limits, spec, qc_um, ("slide_id", "annotation"))
    outcome = tile_slides(manifest, pyramids, masks, *size, spec, vocabulary, strategy, output, keep, stored(outcomes.first_errors(*errors), "errors") if errors else None, check)
    rows = _beside_unlisted(store, outcome.rows, resume)
    path = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("tiles/"), F.col(c))).alias(c)
    table = rows.withColumns({c: path(c) for c in ("coordinates_npz_path", "coordinates_meta_path")})
    made = stored(_with_metadata(wanted, outcome), "made")
    store.replace(outcome.worked, outcome.tiles, made, {"process_list": table.orderBy("row_id"), "summary": summary(outcome.rows)}, texts or {}, whole=not resume)
    return outcome


def _beside_unlisted(store: RunStore, rows: DataFrame, resume: bool) -> DataFrame:
    """The run's rows, and after them those of stored results whose slides the manifest does not list."""
    there = store.settings() if resume else None
    if there is None:
        return rows
    rest = there.join(rows.select("sample_id").distinct(), "sample_id", "left_anti")
    told = runs.process_rows(rest.select("sample_id", "image_path").distinct(), rest.select("sample_id", "annotation", F.col("n_tiles").cast("int").alias("num_tiles"), F.lit(None).cast("string").alias("error")))
    return rows.unionByName(told.withColumn("row_id", F.lit(1 << 60) + F.monotonically_increasing_id()))


def summary(rows: DataFrame) -> DataFrame:
    """(sample_id, annotation, output, status, error): the short table of a run."""
    return rows.select("sample_id", "annotation", names.artifact_stem(F.col("sample_id"), F.col("annotation")).alias("output"), F.col("tiling_status").alias("status"), "error")
