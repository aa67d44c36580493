"""Grouping tiles for reading: aligned dense blocks, greedy blocks, crop offsets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.shared import stored, unstored


def aligned_blocks(tiles: DataFrame, step: int, sizes: tuple[int, ...] = (8, 4, 2)) -> DataFrame:
    """Adds block_size, ax and ay: the largest aligned square block of tiles, all of them there, that the tile belongs to; set-based, any slide size.

    A block's free tiles are counted where they stand: the tiles are dealt by the cells of the largest
    size, in which those of sizes that divide it lie, so that nothing is joined and tiles are read once.
    """
    out = tiles.withColumn("_kx", F.floor(F.col("x") / step)).withColumn("_ky", F.floor(F.col("y") / step)).withColumn("block_size", F.lit(None).cast("int"))
    cell = lambda size: [F.floor(F.col(k) / size) for k in ("_kx", "_ky")]
    for size in sorted(sizes, reverse=True):
        around = [c for s in sorted(sizes, reverse=True) if s > size and s % size == 0 for c in cell(s)]
        free = F.count(F.when(F.col("block_size").isNull(), 1)).over(W.partitionBy("slide_id", *around, *cell(size)))
        out = out.withColumn("_n", free).withColumn("block_size", F.coalesce("block_size", F.when(F.col("_n") == size * size, F.lit(size)))).drop("_n")
    out = out.withColumn("block_size", F.coalesce("block_size", F.lit(1)).cast("int"))
    anchor = lambda k: (F.floor(F.col(k) / F.col("block_size")) * F.col("block_size") * step).cast("bigint")
    return out.withColumn("ax", anchor("_kx")).withColumn("ay", anchor("_ky")).drop("_kx", "_ky")


def index(blocked: DataFrame, step: int, read_step: int) -> DataFrame:
    """Adds st_id, numbered by block size (large first) and place, and the tile's crop offset in the block's region."""
    order = W.partitionBy("slide_id").orderBy(F.desc("block_size"), "ax", "ay")
    plans = blocked.select("slide_id", "block_size", "ax", "ay").distinct().withColumn("st_id", (F.row_number().over(order) - 1).cast("int"))
    offset = lambda c, a: (F.floor((F.col(c) - F.col(a)) / step) * read_step).cast("int")
    return blocked.join(plans, ["slide_id", "block_size", "ax", "ay"]).withColumn("crop_x", offset("x", "ax")).withColumn("crop_y", offset("y", "ay"))


def plans(blocked: DataFrame, tile_px: int, read_step: int) -> DataFrame:
    """One row for each read: anchor, size and how many tiles it serves."""
    size = (F.lit(tile_px) + (F.col("block_size") - 1) * read_step).cast("bigint")
    return blocked.groupBy("slide_id", "block_size", "ax", "ay").agg(F.count(F.lit(1)).alias("n_tiles")).withColumn("read_size_px", size)


def grouped(read_plans: DataFrame) -> DataFrame:
    return read_plans.groupBy("slide_id", "read_size_px").agg(F.count(F.lit(1)).alias("n_plans"), F.sum("n_tiles").cast("bigint").alias("n_tiles"))


def regions(read_plans: DataFrame, step: int, read_step: int) -> DataFrame:
    """The tiles that a read is cut into, x outside and y inside, with their places."""
    k = F.sequence(F.lit(0), F.col("block_size") - 1)
    cut = read_plans.withColumn("_i", F.explode(k)).withColumn("_j", F.explode(k))
    place = lambda a, i, s: (F.col(a) + F.col(i) * s).cast("bigint")
    return cut.select(
        "slide_id", "block_size", "ax", "ay", (F.col("_i") * F.col("block_size") + F.col("_j")).cast("int").alias("pos"), place("ax", "_i", step).alias("x"), place("ay", "_j", step).alias("y"), (F.col("_i") * read_step).cast("int").alias("crop_x"), (F.col("_j") * read_step).cast("int").alias("crop_y")
    )


UNKNOWN, TAKEN, GONE = 0, 1, 2
_SEEN = "slide_id bigint, rx bigint, ry bigint, gx bigint, gy bigint, state int"


def greedy(tiles: DataFrame, step: int, sizes: tuple[int, ...] = (8, 4, 2), region: int = 64) -> DataFrame:
    """Blocks anchored at any tile, taken in the order of x and then y, large ones first; each tile is used once.

    Equal to going through a slide's tiles one by one, but done in regions of region x region tiles
    at once: a block is decided as soon as all earlier blocks that it overlaps are, it is taken if
    none of these was; where the earlier ones lie in another region and are undecided, it
    waits for the next round.  Regions send what is decided near their edges to each other, so a slide of any
    size is worked on by many tasks, and takes about as many rounds as regions a side.
    """
    cell = lambda c: F.floor(F.col(c) / step)
    every = tiles.select("slide_id", "tile_index", F.pmod(F.col("x"), F.lit(step)).cast("bigint").alias("rx"), F.pmod(F.col("y"), F.lit(step)).cast("bigint").alias("ry"), cell("x").alias("gx"), cell("y").alias("gy"))
    free, plans = stored(every, "free"), None
    at = ["slide_id", "rx", "ry", "gx", "gy"]
    for size in sorted({s for s in sizes if s > 1}, reverse=True):
        blocks = _decided(free.select(at), size, region)
        k = F.sequence(F.lit(0), F.lit(size - 1))
        cells = blocks.withColumn("i", F.explode(k)).withColumn("j", F.explode(k))
        cells = cells.select("slide_id", "rx", "ry", (F.col("gx") + F.col("i")).alias("gx"), (F.col("gy") + F.col("j")).alias("gy"), F.lit(size).alias("block_size"), F.col("gx").alias("bx"), F.col("gy").alias("by"), (F.col("i") * size + F.col("j")).cast("int").alias("pos"))
        used = free.join(cells, at)
        plans = used if plans is None else plans.unionByName(used)
        free = stored(free.join(cells.select(at), at, "left_anti"), "free")
    single = free.withColumn("block_size", F.lit(1)).withColumn("bx", F.col("gx")).withColumn("by", F.col("gy")).withColumn("pos", F.lit(0))
    plans = single if plans is None else plans.unionByName(single)
    out = plans.select("slide_id", "block_size", (F.col("bx") * step + F.col("rx")).alias("ax"), (F.col("by") * step + F.col("ry")).alias("ay"), "pos", "tile_index")
    return _numbered(out).select("slide_id", "st_id", "block_size", "ax", "ay", "pos", "tile_index")


def _numbered(plans: DataFrame) -> DataFrame:
    """st_id: blocks of a slide by size, large first, and place; columns of blocks are numbered by offsets, so that no slide is sorted in one task."""
    heads = plans.where("pos = 0")
    column = ["slide_id", "block_size", "ax"]
    before = W.partitionBy("slide_id").orderBy(F.desc("block_size"), "ax").rowsBetween(W.unboundedPreceding, -1)
    offsets = heads.groupBy(*column).agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*column).orderBy("ay")) - 1
    numbers = heads.withColumn("_i", inside).join(offsets, column).select(*column, "ay", (F.col("_o") + F.col("_i")).cast("int").alias("st_id"))
    return plans.join(numbers, [*column, "ay"])


def _around(cells: DataFrame, reach: int, region: int, low: int, keep: list[str]) -> DataFrame:
    """Each cell in its own region and in those within `reach` of it: below and left only (low = 0: regions it is at the far edge of), or on all sides (low = 1)."""
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / region), F.floor((F.col(c) + low * reach) / region)))
    return cells.withColumn("_bx", spread("gx")).withColumn("_by", spread("gy")).select("slide_id", "rx", "ry", "_bx", "_by", "gx", "gy", *keep)


def _decided(free: DataFrame, size: int, region: int) -> DataFrame:
    """The anchors of blocks of one size that are taken: slide_id, rx, ry, gx, gy."""
    key = ["slide_id", "rx", "ry", "_bx", "_by"]

    def whole(cells: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(cells["_bx"].iloc[0]) * region, int(cells["_by"].iloc[0]) * region
        there = np.zeros((region + size - 1, region + size - 1), np.int64)
        there[cells["gx"] - bx, cells["gy"] - by] = 1
        sums = np.pad(there, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
        full = sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size] == size * size
        gx, gy = np.nonzero(full)
        return pd.DataFrame({**{c: cells[c].iloc[0] for c in ("slide_id", "rx", "ry")}, "gx": gx + bx, "gy": gy + by, "state": UNKNOWN}, index=range(len(gx)))

    def decide(anchors: pd.DataFrame) -> pd.DataFrame:
        anchors = anchors.sort_values(["gx", "gy"])
        bx, by = int(anchors["_bx"].iloc[0]) * region, int(anchors["_by"].iloc[0]) * region
        reach = size - 1
        states = np.full((region + 2 * reach, region + 2 * reach), GONE)
        states[anchors["gx"] - bx + reach, anchors["gy"] - by + reach] = anchors["state"]
        own = anchors[anchors["gx"].between(bx, bx + region - 1) & anchors["gy"].between(by, by + region - 1)]
        for x, y in zip((own["gx"] - bx + reach).tolist(), (own["gy"] - by + reach).tolist(), strict=True):
            if states[x, y] == UNKNOWN:
                # of the blocks that overlap, those of earlier columns and those above in the same column come first
                earlier = np.concatenate([states[x - reach : x, y - reach : y + size].ravel(), states[x, y - reach : y]])
                if (earlier == TAKEN).any():
                    states[x, y] = GONE
                elif not (earlier == UNKNOWN).any():
                    states[x, y] = TAKEN
        return own.assign(state=states[own["gx"] - bx + reach, own["gy"] - by + reach])[["slide_id", "rx", "ry", "gx", "gy", "state"]]

    anchors = stored(_around(free, size - 1, region, 0, []).groupBy(*key).applyInPandas(whole, _SEEN), "anchors")
    while True:
        after = stored(_around(anchors, size - 1, region, 1, ["state"]).groupBy(*key).applyInPandas(decide, _SEEN), "anchors")
        unstored(anchors)
        anchors = after
        if anchors.where(F.col("state") == UNKNOWN).isEmpty():
            return anchors.where(F.col("state") == TAKEN).drop("state")
