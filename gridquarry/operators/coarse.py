"""Tissue masks of large slides from few reads: a coarse level finds boxes, and the fine level is read in those only.

A coarse mask's components, enlarged by a margin, are boxes on the fine level.
These are cut along a grid of CELL pixels; a cell that meets boxes is one read, of
the rectangle around their parts in it and the halo that smoothing needs.  What is
in no box is neither read nor tissue.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry import outcomes
from gridquarry.operators import components as cc

CELL = 1024
LOW, HIGH = (90, 8, 103), (180, 255, 255)


def smoothed(pixels: np.ndarray, sigma: float) -> np.ndarray:
    """Rows and columns with a Gaussian that ends three sigmas out, the edge mirrored, rounded half to even."""
    if sigma <= 0:
        return pixels
    radius = max(1, int(3 * sigma + 0.5))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    wide = np.pad(pixels.astype(float), ((radius, radius), (radius, radius), (0, 0)), mode="reflect")
    rows = np.lib.stride_tricks.sliding_window_view(wide, 2 * radius + 1, axis=1) @ weights
    return np.rint(np.lib.stride_tricks.sliding_window_view(rows, 2 * radius + 1, axis=0) @ weights).astype(pixels.dtype)


def in_range(pixels: np.ndarray, low: tuple[int, int, int] = LOW, high: tuple[int, int, int] = HIGH) -> np.ndarray:
    """Whether hue, saturation and value are in a range, by the formulas of `colour`."""
    r, g, b = (pixels[..., k].astype(np.int64) for k in range(3))
    top = np.maximum(np.maximum(r, g), b)
    spread = top - np.minimum(np.minimum(r, g), b)
    some = np.maximum(spread, 1)
    degrees = np.where(top == r, 60.0 * (g - b) / some, np.where(top == g, 120.0 + 60.0 * (b - r) / some, 240.0 + 60.0 * (r - g) / some))
    hue = np.where(spread == 0, 0, np.floor(np.where(degrees < 0, degrees + 360.0, degrees) / 2 + 0.5).astype(np.int64) % 180)
    saturation = np.where(top == 0, 0, (510 * spread + top) // np.maximum(2 * top, 1))
    return np.logical_and.reduce([(c >= a) & (c <= z) for c, a, z in zip((hue, saturation, top), low, high, strict=True)])


def _size(slide, um: float, tolerance: float) -> tuple[int, int]:
    """The whole slide's pixels at a spacing."""
    plan = slide.plan(um, tolerance)
    width, height = slide.reader.level_sizes[plan.level]
    scale = 1.0 if plan.is_near else plan.spacing_um / um
    return max(1, round(width * scale)), max(1, round(height * scale))


def _coarse(slides: DataFrame, coarse_um: float, fine_um: float, sigma_um: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(pixels of the coarse masks with the sizes of both rasters, errors)."""

    def work(row: dict) -> pd.DataFrame:
        from gridquarry.sources.slides import Slide

        slide = Slide.of(row)
        tissue = in_range(smoothed(slide.whole_at(coarse_um, tolerance, "nearest"), sigma_um / coarse_um))
        my, mx = np.nonzero(tissue)
        sizes = (*tissue.shape[::-1], *_size(slide, fine_um, tolerance))
        first = pd.DataFrame({"mx": [-1], "my": [-1]})
        return pd.concat([first, pd.DataFrame({"mx": mx, "my": my})]).assign(**dict(zip(("cw", "ch", "fw", "fh"), sizes, strict=True)))

    return outcomes.attempted(slides, "slide_id", work, "mx bigint, my bigint, cw bigint, ch bigint, fw bigint, fh bigint", "coarse")


def boxes(pixels: DataFrame, margin_px: int, cell: int = CELL) -> DataFrame:
    """One row for each cell of the fine raster that meets boxes: slide_id, cx, cy, fw, fh and parts, the boxes clipped to it."""
    sizes = pixels.where("mx < 0").select("slide_id", "cw", "ch", "fw", "fh")
    widest, tallest = sizes.agg(F.max("cw"), F.max("ch")).first()
    found = cc.areas(cc.components(pixels.where("mx >= 0"), widest or 1, height=tallest or 1)).join(sizes, "slide_id")
    low = lambda c, new, old: F.greatest(F.floor(F.col(c) * F.col(new) / F.col(old)).cast("bigint") - margin_px, F.lit(0))
    high = lambda c, new, old: F.least(F.ceil((F.col(c) + 1) * F.col(new) / F.col(old)).cast("bigint") + margin_px, F.col(new))
    placed = found.select("slide_id", "fw", "fh", low("x0", "fw", "cw").alias("x0"), low("y0", "fh", "ch").alias("y0"), high("x1", "fw", "cw").alias("x1"), high("y1", "fh", "ch").alias("y1"))
    along = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
    cells = placed.withColumn("cx", along("x0", "x1")).withColumn("cy", along("y0", "y1"))
    clip = F.struct(F.greatest("x0", F.col("cx") * cell).alias("x0"), F.greatest("y0", F.col("cy") * cell).alias("y0"), F.least("x1", (F.col("cx") + 1) * cell).alias("x1"), F.least("y1", (F.col("cy") + 1) * cell).alias("y1"))
    return cells.groupBy("slide_id", "cx", "cy").agg(F.first("fw").alias("fw"), F.first("fh").alias("fh"), F.collect_set(clip).alias("parts"))


RUNS = "slide_id bigint, cx bigint, cy bigint, y bigint, x0 bigint, x1 bigint, n_read bigint, error string"


def _fine(cells: DataFrame, fine_um: float, sigma_px: float, tolerance: float) -> DataFrame:
    """Runs of tissue in each cell, and a row without a run that says how many pixels were read, or why none."""
    halo = max(1, int(3 * sigma_px + 0.5)) if sigma_px > 0 else 0

    def judged(slide, row: dict) -> tuple[list[tuple[int, int, int]], int]:
        parts = [tuple(p[c] for c in ("x0", "y0", "x1", "y1")) for p in row["parts"]]
        x0, y0, x1, y1 = (f(p[k] for p in parts) for k, f in enumerate((min, min, max, max)))
        rx0, ry0, rx1, ry1 = max(x0 - halo, 0), max(y0 - halo, 0), min(x1 + halo, row["fw"]), min(y1 + halo, row["fh"])
        scale = fine_um / slide.spacing_um
        pixels = slide.region_at(round(rx0 * scale), round(ry0 * scale), fine_um, rx1 - rx0, ry1 - ry0, tolerance, "nearest")
        tissue = in_range(smoothed(pixels, sigma_px))[y0 - ry0 : y1 - ry0, x0 - rx0 : x1 - rx0]
        wanted = np.zeros_like(tissue)
        for a, b, c, d in parts:
            wanted[b - y0 : d - y0, a - x0 : c - x0] = True
        edges = np.diff((tissue & wanted).astype(np.int8), axis=1, prepend=0, append=0)
        (ys, begins), (_, ends) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        return list(zip((ys + y0).tolist(), (begins + x0).tolist(), (ends + x0).tolist(), strict=True)), pixels.shape[0] * pixels.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridquarry.sources.slides import Slide

        named, slide = None, None
        for batch in batches:
            for row in batch.to_pylist():
                runs, n, error = [], 0, None
                try:
                    if row["slide_id"] != named:
                        slide, named = Slide.of(row), row["slide_id"]
                    runs, n = judged(slide, row)
                except Exception as failed:  # noqa: BLE001
                    named, error = None, outcomes.reason(failed)
                at = row["slide_id"], row["cx"], row["cy"]
                out = [(*at, None, None, None, n, error), *((*at, y, a, b, None, None) for y, a, b in runs)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=[c.split()[0] for c in RUNS.split(", ")])

    return cells.repartition("slide_id", "cx", "cy").sortWithinPartitions("slide_id").mapInArrow(run, RUNS)


def masks(slides: DataFrame, fine_um: float, coarse_um: float, margin_um: float, sigma_um: float = 0.0, tolerance: float = 0.05, cell: int = CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, reads, errors).  slides: slide_id, base_spacing_um, and image_path and backend, or image.

    runs: slide_id, y, x0, x1 (exclusive) of tissue at fine_um.  reads: slide_id, cx, cy, n_read, one for each cell that
    was read.  errors: slide_id, error, of slides that could not be read; their runs are not to be used.
    """
    from gridquarry.shared import stored

    pixels, broken = _coarse(slides, coarse_um, fine_um, sigma_um, tolerance)
    known = [c for c in ("slide_id", "image_path", "backend", "image", "base_spacing_um") if c in slides.columns]
    cells = boxes(pixels, round(margin_um / fine_um), cell).join(slides.select(known), "slide_id")
    found = stored(_fine(cells, fine_um, sigma_um / fine_um, tolerance), "runs")
    late = found.where("error is not null").groupBy("slide_id").agg(F.min("error").alias("error"))
    errors = outcomes.first_errors(broken, late, key="slide_id")
    return found.where("y is not null").select("slide_id", "y", "x0", "x1"), found.where("y is null and error is null").select("slide_id", "cx", "cy", "n_read"), errors


def pixels_of(runs: DataFrame) -> DataFrame:
    """slide_id, mx, my of runs."""
    return runs.select("slide_id", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("mx"), F.col("y").alias("my"))
