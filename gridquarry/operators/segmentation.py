"""Tissue masks from colour: fixed ranges, thresholds, Otsu; filters over neighbourhoods, resampling.

Filters work on square blocks of BLOCK pixels with a margin of the neighbours
they need, as arrays in tasks, so a pixel travels once and to the few blocks
beside it at most, whatever the size of the neighbourhood or of the raster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.functions import colour
from gridquarry.operators import components as cc
from gridquarry.shared import stored


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


def with_saturation(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("s", colour.saturation(*_rgb()))


def hsv_range(pixels: DataFrame, low: tuple[int, int, int] = (90, 8, 103), high: tuple[int, int, int] = (180, 255, 255)) -> DataFrame:
    parts = (colour.hue(*_rgb()), colour.saturation(*_rgb()), colour.value(*_rgb()))
    inside = F.lit(True)
    for c, a, b in zip(parts, low, high, strict=True):
        inside &= c.between(a, b)
    return pixels.withColumn("tissue", inside)


#: Side of the blocks that neighbourhood filters work on.
BLOCK = 128
#: Kinds of values that they return.
ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


def over_blocks(values: DataFrame, columns: str | tuple[str, ...], margin: int, fn: Callable[[np.ndarray], np.ndarray], kind: str, edge: str | float = "edge", key: str = "slide_id", block: int | None = None, out: str | None = None) -> DataFrame:
    """(key, x, y, columns or out): fn of each block of a dense raster with `margin` pixels around it, which returns the block without them.

    edge: "edge" repeats the raster's outer pixels, "reflect" mirrors at them, a number stands outside.
    Blocks that lie alike are handed over many at once: fn works on the last two axes.
    Where the raster ends is seen from the pixels that a block gets, as it is dense.
    """
    block = block or BLOCK
    columns = (columns,) if isinstance(columns, str) else columns
    named = [out] if out else list(columns)
    near = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - margin) / block), F.lit(0)), F.floor((F.col(c) + margin) / block)))
    spread = values.select(key, "x", "y", *(F.col(c).alias(f"_v{k}") for k, c in enumerate(columns))).withColumn("_bx", near("x")).withColumn("_by", near("y"))
    dealt = spread.repartition(key, "_bx", "_by").sortWithinPartitions(key, "_bx", "_by")
    told = ARROW[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in cc._whole_groups(batches, [key, "_bx", "_by"]):
            first = np.flatnonzero(np.diff(group, prepend=-1))
            low_x, low_y = (rows[c].to_numpy()[first].astype(np.int64) * block for c in ("_bx", "_by"))
            x, y = rows["x"].to_numpy() - low_x[group], rows["y"].to_numpy() - low_y[group]
            found = [rows[f"_v{k}"].to_numpy() for k in range(len(columns))]
            boxes = np.stack([np.minimum.reduceat(x, first), np.minimum.reduceat(y, first), np.maximum.reduceat(x, first) + 1, np.maximum.reduceat(y, first) + 1], axis=1)
            shapes, shape_of = np.unique(boxes, axis=0, return_inverse=True)
            for k, (x0, y0, x1, y1) in enumerate(shapes.tolist()):
                width, height = min(block, x1), min(block, y1)
                if width <= 0 or height <= 0:
                    continue
                own = np.flatnonzero(shape_of.ravel() == k)
                place = np.full(len(first), -1)
                place[own] = np.arange(len(own))
                at = place[group]
                here = np.flatnonzero(at >= 0)
                inside = np.zeros((len(columns), len(own), y1 - y0, x1 - x0), np.result_type(*found))
                for c, v in enumerate(found):
                    inside[c, at[here], y[here] - y0, x[here] - x0] = v[here]
                pads = ((0, 0), (0, 0), (margin + y0, height + margin - y1), (margin + x0, width + margin - x1))
                whole = np.pad(inside, pads, mode=edge) if isinstance(edge, str) else np.pad(inside, pads, constant_values=edge)
                done = fn(whole)
                at_y, at_x = np.divmod(np.tile(np.arange(width * height), len(own)), width)
                of = np.repeat(own, width * height)
                got = [rows[key].take(pa.array(first[of])), pa.array(at_x + low_x[of]), pa.array(at_y + low_y[of]), *(pa.array(d.ravel().astype(told.to_pandas_dtype())) for d in done)]
                yield from pa.table(got, names=[key, "x", "y", *named]).to_batches()

    return dealt.mapInArrow(run, f"`{key}` {dict(values.dtypes)[key]}, x bigint, y bigint, " + ", ".join(f"`{c}` {kind}" for c in named))


def windows_of(whole: np.ndarray, size: int) -> np.ndarray:
    """All size x size neighbourhoods of the last two axes as one more axis."""
    seen = np.lib.stride_tricks.sliding_window_view(whole, (size, size), axis=(-2, -1))
    return seen.reshape(*seen.shape[:-2], size * size)


def median(values: DataFrame, column: str, radius: int = 1, key: str = "slide_id", block: int | None = None) -> DataFrame:
    """(key, x, y, median): middle of the square neighbourhood, the edge repeated outwards."""
    size = 2 * radius + 1
    kind = dict(values.dtypes)[column]

    def fn(whole: np.ndarray) -> np.ndarray:
        lines = [np.partition(windows_of(whole[..., y : y + size + 7, :], size), size * size // 2, axis=-1)[..., size * size // 2] for y in range(0, whole.shape[-2] - size + 1, 8)]
        return np.concatenate(lines, axis=-2)

    return over_blocks(values, column, radius, fn, kind, "edge", key, block, "median")


def gaussian(values: DataFrame, columns: str | tuple[str, ...], sigma: float, key: str = "slide_id", block: int | None = None) -> DataFrame:
    """(key, x, y, columns): smoothed by rows and columns, the edge mirrored, rounded half to even; the kernel ends three sigmas out.  A sigma of 0 leaves the values."""
    columns = (columns,) if isinstance(columns, str) else columns
    if sigma <= 0:
        return values.select(key, "x", "y", *columns)
    radius = max(1, int(3 * sigma + 0.5))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()

    def fn(whole: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(whole.astype(float), 2 * radius + 1, axis=-1) @ weights
        return np.rint(np.lib.stride_tricks.sliding_window_view(rows, 2 * radius + 1, axis=-2) @ weights).astype(whole.dtype)

    return over_blocks(values, columns, radius, fn, dict(values.dtypes)[columns[0]], "reflect", key, block)


def ellipse(radius: int) -> np.ndarray:
    """The offsets (dy, dx) of a filled ellipse in a square of 2 * radius + 1, row by row: half widths are those of the circle, rounded."""
    y = np.arange(-radius, radius + 1)
    half = np.rint(radius * np.sqrt(np.maximum(0.0, (radius**2 - y**2) / max(1, radius**2)))).astype(int)
    return np.array([(dy, dx) for dy, h in zip(y.tolist(), half.tolist(), strict=True) for dx in range(-h, h + 1)])


def morphed(mask: DataFrame, radius: int, steps: str, key: str = "slide_id", block: int | None = None) -> DataFrame:
    """mask: key, x, y, v (0 or 1), dense.  steps: d dilates and e erodes with an ellipse, one after the other; what lies outside the raster takes no part."""
    return _morphed(mask, [(radius, step) for step in steps], key, block)


def _morphed(mask: DataFrame, steps: list[tuple[int, str]], key: str = "slide_id", block: int | None = None) -> DataFrame:
    """Steps of (radius, d or e); those whose margins are half a block together are done in one pass."""
    left, out = [s for s in steps if s[0] > 0], mask.select(key, "x", "y", "v")
    while left:
        n = 1
        while n < len(left) and 2 * sum(r for r, _ in left[: n + 1]) <= (block or BLOCK):
            n += 1
        out, left = over_blocks(out, "v", sum(r for r, _ in left[:n]), _steps(left[:n]), "int", OUTSIDE, key, block), left[n:]
    return out


#: Stands outside the raster while blocks are dilated and eroded.
OUTSIDE = 2


def _steps(steps: list[tuple[int, str]]) -> Callable[[np.ndarray], np.ndarray]:
    def fn(whole: np.ndarray) -> np.ndarray:
        beyond = whole == OUTSIDE
        for radius, step in steps:
            whole = np.where(beyond, 0 if step == "d" else 1, whole)
            height, width = whole.shape[-2] - 2 * radius, whole.shape[-1] - 2 * radius
            seen = [whole[..., radius + dy : radius + dy + height, radius + dx : radius + dx + width] for dy, dx in ellipse(radius).tolist()]
            whole = (np.maximum if step == "d" else np.minimum).reduce(seen)
            beyond = beyond[..., radius : radius + height, radius : radius + width]
        return whole

    return fn


def threshold(values: DataFrame, column: str, above: int) -> DataFrame:
    return values.withColumn("tissue", F.col(column) > above)


def otsu(values: DataFrame, column: str, key: str = "slide_id") -> DataFrame:
    """(key, threshold): the value with the largest between-class variance, the first of equals; at most 256 rows a key reach the window."""
    bins = values.groupBy(key, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto, all_ = W.partitionBy(key).orderBy("v").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(key)
    summed = bins.select(key, "v", F.sum("n").over(upto).alias("n0"), F.sum(F.col("v") * F.col("n")).over(upto).alias("s0"), F.sum("n").over(all_).alias("n1"), F.sum(F.col("v") * F.col("n")).over(all_).alias("s1"))
    gap = (F.col("s0") * F.col("n1") - F.col("s1") * F.col("n0")).cast("double")
    between = F.when(F.col("n0") < F.col("n1"), gap * gap / (F.col("n0") * (F.col("n1") - F.col("n0"))).cast("double")).otherwise(F.lit(0.0))
    return summed.withColumn("between", between).groupBy(key).agg(F.max(F.struct(F.col("between"), (-F.col("v")).alias("v"))).alias("m")).select(key, (-F.col("m.v")).cast("int").alias("threshold"))


def closed(mask: DataFrame, size: int = 3, key: str = "slide_id") -> DataFrame:
    """mask: key, mx, my, v (0 or 1), dense.  Dilate, then erode, with a square of the given side; a square goes by rows and then by columns.

    The middle of an even side is the pixel right of and below its centre, in both steps.
    """
    before, after = size // 2, size - 1 - size // 2

    def along(df: DataFrame, fn: Callable) -> DataFrame:
        for line, order in (("my", "mx"), ("mx", "my")):
            df = df.withColumn("v", fn("v").over(W.partitionBy(key, line).orderBy(order).rowsBetween(-before, after)))
        return df

    return along(along(mask, F.max), F.min) if size > 1 else mask


#: Methods of segmentation.
METHODS = ("hsv", "otsu", "threshold")


def segmented(pixels: DataFrame, method: str = "hsv", saturation: int = 8, radius: int = 3, close: int = 4, block: int | None = None, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(slide_id, mx, my) of tissue in dense thumbnails (slide_id, x, y, r, g, b): hsv, otsu, threshold, or a model of the caller's, which maps the pixels to (slide_id, x, y, tissue); then closing with a square of side `close`."""
    if method == "model":
        if model is None:
            raise ValueError("method model needs a model")
        found = model(pixels)
    elif method == "hsv":
        found = hsv_range(pixels)
    elif method in ("otsu", "threshold"):
        smooth = median(with_saturation(pixels), "s", radius, block=block)
        found = otsu_mask(smooth, "median") if method == "otsu" else threshold(smooth, "median", saturation)
    else:
        raise ValueError(f"unknown segmentation method {method!r}")
    dense = found.select("slide_id", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("tissue").cast("int").alias("v"))
    return closed(dense, close).where("v = 1").select("slide_id", "mx", "my")


def otsu_mask(values: DataFrame, column: str, key: str = "slide_id") -> DataFrame:
    """values with tissue: above the threshold of its own raster."""
    return values.join(otsu(values, column, key), key).withColumn("tissue", F.col(column) > F.col("threshold")).drop("threshold")


def fine_mask(pixels: DataFrame, sigma: float = 0.0, low: tuple[int, int, int] = (90, 8, 103), high: tuple[int, int, int] = (180, 255, 255), block: int | None = None) -> DataFrame:
    """(slide_id, x, y, v): the colour range of smoothed channels, 0 or 1."""
    if sigma > 0:
        pixels = gaussian(pixels, ("r", "g", "b"), sigma, block=block)
    return hsv_range(pixels, low, high).select("slide_id", "x", "y", F.col("tissue").cast("int").alias("v"))


def postprocessed(dense: DataFrame, width: int, height: int, least_px: int = 0, hole_px: int = 0, close_radius: int = 0, open_radius: int = 0, block: int | None = None) -> DataFrame:
    """dense: slide_id, x, y, v.  Small components go, small holes fill, then closing and opening with ellipses; each step only where its size is above 0."""
    if least_px > 0 or hole_px > 0:
        dense = stored(dense.select("slide_id", "x", "y", "v"), "dense")
    slides = dense.select("slide_id").distinct()
    mask = dense.where("v = 1").select("slide_id", F.col("x").alias("mx"), F.col("y").alias("my"))
    if least_px > 0:
        mask = cc.without_small(cc.components(mask, width, block, height=height), least_px).select("slide_id", "mx", "my")
    if hole_px > 0:
        mask = cc.filled(mask, slides, width, height, hole_px, block)
    on = mask.select("slide_id", F.col("mx").alias("x"), F.col("my").alias("y"), F.lit(1).alias("_on"))
    out = dense.select("slide_id", "x", "y").join(on, ["slide_id", "x", "y"], "left").select("slide_id", "x", "y", F.coalesce("_on", F.lit(0)).alias("v"))
    return _morphed(out, [(close_radius, "d"), (close_radius, "e"), (open_radius, "e"), (open_radius, "d")], block=block)


def coarse_to_fine(pixels: DataFrame, factor: int, margin: int, width: int, height: int, sigma: float = 0.0, block: int | None = None) -> DataFrame:
    """(slide_id, x, y, v) on the full raster: a mask of every factor-th pixel finds boxes of tissue, and only pixels in boxes with a margin are judged; the others are 0.

    For pixels that are there as rows.  Where they are still in files, `coarse.masks` reads boxes alone.
    """
    coarse = pixels.where((F.col("x") % factor == 0) & (F.col("y") % factor == 0)).withColumn("x", F.floor(F.col("x") / factor)).withColumn("y", F.floor(F.col("y") / factor))
    found = fine_mask(coarse, block=block).where("v = 1").select("slide_id", F.col("x").alias("mx"), F.col("y").alias("my"))
    boxes = cc.roi_boxes(cc.components(found, -(-width // factor), block, height=-(-height // factor)), factor, margin, width, height)
    wide = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 64), F.floor((F.col(b) - 1) / 64)))
    cells = boxes.withColumn("_cx", wide("x0", "x1")).withColumn("_cy", wide("y0", "y1"))
    near = pixels.withColumn("_cx", F.floor(F.col("x") / 64)).withColumn("_cy", F.floor(F.col("y") / 64)).select("slide_id", "x", "y", "_cx", "_cy")
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    places = near.join(cells, ["slide_id", "_cx", "_cy"]).where(inside).select("slide_id", "x", "y").distinct()
    asked = pixels if sigma > 0 else pixels.join(places, ["slide_id", "x", "y"], "left_semi")
    judged = fine_mask(asked, sigma, block=block).join(places, ["slide_id", "x", "y"], "left_semi")
    return pixels.select("slide_id", "x", "y").join(judged, ["slide_id", "x", "y"], "left").select("slide_id", "x", "y", F.coalesce("v", F.lit(0)).alias("v"))


def resampled(labels: DataFrame, factor: int, key: str = "slide_id") -> DataFrame:
    """Nearest-neighbour enlargement of a label raster by a whole factor."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    wide = labels.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return wide.select(key, (F.col("mx") * factor + F.col("_dx")).cast("bigint").alias("mx"), (F.col("my") * factor + F.col("_dy")).cast("bigint").alias("my"), "label")


def resized_labels(labels: DataFrame, source: tuple[int, int], target: tuple[int, int], key: str = "slide_id") -> DataFrame:
    """Nearest-neighbour resampling of a sparse label raster of source (width, height) to target, larger or smaller: place p comes from floor(p * source / target)."""
    def spread(c: str, old: int, new: int):
        first = F.floor((F.col(c) * new + (old - 1)) / old)
        last = F.floor(((F.col(c) + 1) * new + (old - 1)) / old) - 1
        return F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))

    wide = labels.select(key, spread("mx", source[0], target[0]).alias("mx"), "my", "label")
    return wide.select(key, "mx", spread("my", source[1], target[1]).alias("my"), "label")


def collapsed_labels(pixels: DataFrame) -> DataFrame:
    """pixels: slide_id, x, y, r, g, b of a label image whose channels agree.  (slide_id, mx, my, label); a colour image or a fraction is an error."""
    whole = (F.col("r") == F.floor("r")) & (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    label = F.when(whole, F.col("r").cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a label image: slide "), F.col("slide_id").cast("string"))))
    return pixels.select("slide_id", F.col("x").alias("mx"), F.col("y").alias("my"), label.alias("label"))


def discreteness(pixels: DataFrame) -> DataFrame:
    """By slide: the number of values, whether they are whole, whether all channels agree, and whether there are two at most."""
    flag = lambda c: F.min(c.cast("int")) == 1
    return pixels.groupBy("slide_id").agg(
        F.countDistinct("r").alias("n_values"),
        flag(F.col("r") == F.floor("r")).alias("whole"),
        flag((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("one_channel"),
        (F.countDistinct("r") <= 2).alias("binary_like"),
    )


def mask_pyramid(mask: DataFrame, size: int, least: int, key: str = "slide_id") -> DataFrame:
    """(level, key, mx, my): nearest downsampling by two until the side would fall below `least`."""
    out, level, side = mask.select(F.lit(0).alias("level"), key, "mx", "my"), 0, size
    while side // 2 >= least:
        level, side = level + 1, side // 2
        step = 2**level
        kept = mask.where((F.col("mx") % step == 0) & (F.col("my") % step == 0))
        out = out.unionByName(kept.select(F.lit(level).alias("level"), key, F.floor(F.col("mx") / step).alias("mx"), F.floor(F.col("my") / step).alias("my")))
    return out


def thumbnail_plan(slides: DataFrame, spacing: float = 8.0) -> DataFrame:
    """Size of the thumbnail at the given spacing."""
    side = lambda c: F.greatest(F.lit(1.0), F.rint(F.col(c) * F.col("base_spacing_um") / F.lit(spacing))).cast("bigint")
    return slides.withColumn("thumb_w", side("slide_w")).withColumn("thumb_h", side("slide_h"))
