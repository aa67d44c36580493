"""How much of a tile a mask covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.functions import geometry as g


def windows(tiles: DataFrame, mask_w: int, mask_h: int) -> DataFrame:
    """Each tile's window on the mask: wx, wy floor, ww, wh round and are 1 at least.  tiles: x, y, tile, slide_w, slide_h."""
    sx, sy = F.lit(float(mask_w)) / F.col("slide_w"), F.lit(float(mask_h)) / F.col("slide_h")
    return (
        tiles.withColumn("wx", g.project_origin(F.col("x"), sx))
        .withColumn("wy", g.project_origin(F.col("y"), sy))
        .withColumn("ww", g.project_size(F.col("tile"), sx))
        .withColumn("wh", g.project_size(F.col("tile"), sy))
    )


def covered(tiles: DataFrame, mask: DataFrame, keys: list[str], cell: int = 8, zero: bool = False) -> DataFrame:
    """tiles with n_px and frac (float), the share of the whole tile area that mask pixels (keys..., mx, my) cover.

    Tiles and pixels meet in square cells of the mask: a tile is copied to the few cells that its
    window touches, a pixel stands in one, and the rest is an equality join with counts combined
    before the shuffle.  Tiles without a pixel are left out unless `zero`.  Spark takes a grid of
    tiles for as small as the slides that it is made from, so the joins are told to sort instead
    of sending it through the driver.
    """
    tiles = tiles.hint("merge")
    touched = lambda low, size: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(low) + F.col(size) - 1) / cell)))
    spread = tiles.select(*keys, "x", "y", "wx", "wy", "ww", "wh").withColumn("_cx", touched("wx", "ww")).withColumn("_cy", touched("wy", "wh"))
    pixels = mask.select(*keys, "mx", "my", F.floor(F.col("mx") / cell).alias("_cx"), F.floor(F.col("my") / cell).alias("_cy"))
    inside = (F.col("mx") >= F.col("wx")) & (F.col("mx") < F.col("wx") + F.col("ww")) & (F.col("my") >= F.col("wy")) & (F.col("my") < F.col("wy") + F.col("wh"))
    counts = spread.join(pixels, [*keys, "_cx", "_cy"]).where(inside).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n_px"))
    out = tiles.join(counts, [*keys, "x", "y"], "left" if zero else "inner").withColumn("n_px", F.coalesce("n_px", F.lit(0)).cast("bigint"))
    return out.withColumn("frac", (F.col("n_px") / (F.col("ww") * F.col("wh"))).cast("float"))


def at_least(tiles: DataFrame, threshold: float) -> DataFrame:
    """Compared in single precision, both sides."""
    return tiles.where(F.col("frac") >= F.lit(threshold).cast("float"))


def integral_image(mask: DataFrame, slides: DataFrame, width: int, height: int) -> DataFrame:
    """Prefix sums of the mask: (slide_id, ix, iy, total) with exclusive indices 1..width, 1..height."""
    axis = lambda n, c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(c)
    dense = slides.select("slide_id", axis(width, "mx")).select("slide_id", "mx", axis(height, "my"))
    on = dense.join(mask.select("slide_id", "mx", "my", F.lit(1).alias("v")), ["slide_id", "mx", "my"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    rows = on.withColumn("r", F.sum("v").over(W.partitionBy("slide_id", "my").orderBy("mx").rowsBetween(W.unboundedPreceding, 0)))
    total = F.sum("r").over(W.partitionBy("slide_id", "mx").orderBy("my").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("slide_id", (F.col("mx") + 1).alias("ix"), (F.col("my") + 1).alias("iy"), total.alias("total"))


def coverage_from_integral(tiles: DataFrame, integral: DataFrame, mask_w: int, mask_h: int) -> DataFrame:
    """n_px of every tile by four corner look-ups; a missing corner is index 0, whose sum is 0."""
    edge = lambda low, size, most: F.least(F.greatest(F.col(low) + size, F.lit(0)), F.lit(most)).cast("bigint")
    x0, x1, y0, y1 = edge("wx", F.lit(0), mask_w), edge("wx", F.col("ww"), mask_w), edge("wy", F.lit(0), mask_h), edge("wy", F.col("wh"), mask_h)
    corner = lambda x, y, s: F.struct(x.alias("ix"), y.alias("iy"), F.lit(s).alias("sign"))
    corners = tiles.withColumn("_c", F.explode(F.array(corner(x1, y1, 1), corner(x0, y1, -1), corner(x1, y0, -1), corner(x0, y0, 1))))
    got = corners.withColumn("ix", F.col("_c.ix")).withColumn("iy", F.col("_c.iy")).join(integral, ["slide_id", "ix", "iy"], "left")
    return got.groupBy("slide_id", "x", "y").agg(F.sum(F.coalesce("total", F.lit(0)) * F.col("_c.sign")).cast("bigint").alias("n_px"))


def coverage_summary(labels: DataFrame, vocabulary: DataFrame, tiles: DataFrame, spacing: float) -> DataFrame:
    """By annotation: area_mm2, share of the thresholded annotations' area, and tiles that reach the threshold.

    labels: slide_id, annotation, mx, my.  tiles: with windows.  vocabulary: annotation, min_coverage.
    """
    area = labels.groupBy("slide_id", "annotation").agg(F.count(F.lit(1)).alias("px")).join(F.broadcast(vocabulary), "annotation")
    mm2 = F.col("px") * F.lit(spacing / 1000.0) * F.lit(spacing / 1000.0)
    wanted = F.when(F.col("min_coverage").isNotNull(), F.col("px"))
    total = F.sum(wanted).over(W.partitionBy("slide_id"))
    own = tiles.crossJoin(F.broadcast(vocabulary.where("min_coverage is not null")))
    enough = covered(own, labels, ["slide_id", "annotation"]).where(F.col("frac") >= F.col("min_coverage").cast("float"))
    est = enough.groupBy("slide_id", "annotation").agg(F.count(F.lit(1)).alias("est"))
    out = area.withColumn("area_mm2", mm2).withColumn("frac", wanted / total).join(est, ["slide_id", "annotation"], "left")
    return out.select("slide_id", "annotation", "area_mm2", "frac", F.when(F.col("min_coverage").isNotNull(), F.coalesce("est", F.lit(0))).cast("bigint").alias("est_tiles"))
