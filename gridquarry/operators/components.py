"""Connected components of sparse masks, and what is measured on them.

Pixels are labelled inside blocks of BLOCK x BLOCK with numpy, then MERGED x MERGED
blocks at a time are joined through the pixels on their rims, of which only those on
the rim of the whole go on.  So no task ever holds more than a block or the rims of a
few, and a raster of n blocks a side takes log n passes over ever fewer pixels.  A mask belongs to a
slide, or to a slide and more (an annotation, say): `keys` names the columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.shared import stored

BLOCK = 256
#: Blocks a side that are joined at once.
MERGED = 4
_EIGHT = ((1, 0), (0, 1), (1, 1), (1, -1))
KEYS = ("slide_id",)


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links between a[i] and b[i]: the smallest node reachable."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        while (jumped := after[after] != after).any():
            after = np.where(jumped, after[after], after)
        if (after == label).all():
            break
        label = after
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _starts(rows: pa.Table, names: list[str]) -> np.ndarray:
    """Where the rows of another group begin."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for name in names:
        column = rows[name].combine_chunks()
        column = column.dictionary_encode().indices if not pa.types.is_integer(column.type) else column
        value = column.fill_null(-1).to_numpy(zero_copy_only=False)
        out[1:] |= value[1:] != value[:-1]
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of several whole groups at once, from rows in order of their groups, and the number of each row's group."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        begins = _starts(rows, names)
        last = int(np.flatnonzero(begins)[-1]) if rows.num_rows else 0
        if last:
            yield rows.slice(0, last), np.cumsum(begins[:last]) - 1
        held = rows.slice(last)
    if held is not None and held.num_rows:
        yield held, np.cumsum(_starts(held, names)) - 1


def _linked(group: np.ndarray, mx: np.ndarray, my: np.ndarray, label: np.ndarray, width: int, height: int, steps: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The smallest label that each pixel's label hangs together with; pixels meet inside their groups only."""
    code = (group * height + my) * width + mx
    order = np.argsort(code)
    code, mx, my, names = code[order], mx[order], my[order], (group * height * width + label)[order]
    known, at = np.unique(names, return_inverse=True)
    a, b = [], []
    for dx, dy in steps:
        other = np.minimum(np.searchsorted(code, code + dy * width + dx), len(code) - 1)
        met = np.flatnonzero((code[other] == code + dy * width + dx) & (mx + dx >= 0) & (mx + dx < width) & (my + dy >= 0) & (my + dy < height) & (at[other] != at))
        a.append(at[met])
        b.append(at[other[met]])
    root = least_reachable(len(known), np.concatenate(a), np.concatenate(b))
    out = np.empty(len(order), np.int64)
    out[order] = known[root[at]] % (height * width)
    return out


def _integers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[c].to_numpy().astype(np.int64) for c in names]


def components(mask: DataFrame, width: int, block: int | None = None, keys: tuple[str, ...] = KEYS, connectivity: int = 8, height: int | None = None) -> DataFrame:
    """mask: keys..., mx, my.  Adds component: the smallest my * width + mx among the pixels that hang together, by 8 or by 4 neighbours.  Blocks are of BLOCK x BLOCK if not stated."""
    block = block or BLOCK
    steps = _EIGHT if connectivity == 8 else _EIGHT[:2]
    own = mask.select(*keys, "mx", "my").distinct()
    kinds = dict(own.dtypes)
    told = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "mx", "my"))
    if height is None:
        own = stored(own, "mask")
        height = int(own.agg(F.max("my")).first()[0] or 0) + 1
    local = stored(_dealt(own, keys, block).mapInArrow(_label(width, height, steps, keys), told + ", local bigint"), "local")
    rims, maps, side = local.where(_on_rim(block)), [], block
    while side < max(width, height):
        side *= MERGED
        level = stored(_dealt(rims, keys, side).mapInArrow(_merge(width, height, steps, side, keys), told + ", local bigint, root bigint"), "rims")
        maps.append(level.where("root is not null").select(*keys, "local", "root"))
        rims = level.where("root is null").drop("root")
    out = local.withColumnRenamed("local", "component")
    for names in maps:
        out = out.join(names.withColumnRenamed("local", "component"), [*keys, "component"], "left").select(*keys, "mx", "my", F.coalesce("root", "component").alias("component"))
    return out


def _on_rim(side: int) -> Column:
    return (F.col("mx") % side).isin(0, side - 1) | (F.col("my") % side).isin(0, side - 1)


def _dealt(pixels: DataFrame, keys: tuple[str, ...], side: int) -> DataFrame:
    placed = pixels.withColumn("_bx", F.floor(F.col("mx") / side)).withColumn("_by", F.floor(F.col("my") / side))
    return placed.repartition(*keys, "_bx", "_by").sortWithinPartitions(*keys, "_bx", "_by")


def _label(width: int, height: int, steps: tuple[tuple[int, int], ...], keys: tuple[str, ...]):
    """Pixels of whole blocks with the first place of what they hang together with inside their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_groups(batches, [*keys, "_bx", "_by"]):
            mx, my = _integers(rows, "mx", "my")
            local = _linked(group, mx, my, my * width + mx, width, height, steps)
            yield from pa.table([*(rows[c] for c in (*keys, "mx", "my")), pa.array(local)], names=[*keys, "mx", "my", "local"]).to_batches()

    return run


def _merge(width: int, height: int, steps: tuple[tuple[int, int], ...], side: int, keys: tuple[str, ...]):
    """Of the rims of MERGED x MERGED blocks: which labels are one (root is set), and the pixels on the rim of the whole (root is not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_groups(batches, [*keys, "_bx", "_by"]):
            mx, my, local = _integers(rows, "mx", "my", "local")
            root = _linked(group, mx, my, local, width, height, steps)
            rim = np.flatnonzero(np.isin(mx % side, (0, side - 1)) | np.isin(my % side, (0, side - 1)))
            moved = np.flatnonzero(root != local)
            moved = moved[np.unique(group[moved] * (width * height) + local[moved], return_index=True)[1]]
            take = pa.array(np.concatenate([rim, moved]))
            told = pa.array(np.concatenate([root[rim], local[moved]]))
            roots = pa.array(np.concatenate([root[rim], root[moved]]), mask=np.arange(len(take)) < len(rim))
            yield from pa.table([*(rows[c].take(take) for c in (*keys, "mx", "my")), told, roots], names=[*keys, "mx", "my", "local", "root"]).to_batches()

    return run


def areas(labelled: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("area"), F.min("mx").alias("x0"), F.min("my").alias("y0"), F.max("mx").alias("x1"), F.max("my").alias("y1"))


def without_small(labelled: DataFrame, least: int) -> DataFrame:
    return labelled.join(areas(labelled).where(F.col("area") >= least).select("slide_id", "component"), ["slide_id", "component"], "left_semi")


def complement(mask: DataFrame, slides: DataFrame, width: int, height: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    axis = lambda n, c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(c)
    dense = slides.select(*keys, axis(width, "mx")).select(*keys, "mx", axis(height, "my"))
    return dense.join(mask.select(*keys, "mx", "my"), [*keys, "mx", "my"], "left_anti")


def holes(mask: DataFrame, slides: DataFrame, width: int, height: int, keys: tuple[str, ...] = KEYS, connectivity: int = 8, block: int | None = None) -> DataFrame:
    """Background components that do not touch the raster's border, with their pixels.  slides: the keys of all rasters."""
    back = components(complement(mask, slides, width, height, keys), width, block, keys, connectivity, height)
    inner = areas(back, keys).where((F.col("x0") > 0) & (F.col("y0") > 0) & (F.col("x1") < width - 1) & (F.col("y1") < height - 1))
    return back.join(inner.select(*keys, "component", "area"), [*keys, "component"])


def filled(mask: DataFrame, slides: DataFrame, width: int, height: int, most: int, block: int | None = None) -> DataFrame:
    """The mask with holes of at most `most` pixels filled."""
    own = holes(mask, slides, width, height, block=block).where(F.col("area") <= most)
    return mask.select("slide_id", "mx", "my").union(own.select("slide_id", "mx", "my")).distinct()


def hole_parents(hole_px: DataFrame, labelled: DataFrame) -> DataFrame:
    """(slide_id, hole, parent): the component of the pixel left of the hole's first pixel."""
    first = hole_px.groupBy("slide_id", F.col("component").alias("hole")).agg(F.min(F.struct("my", "mx")).alias("p"), F.count(F.lit(1)).alias("area"))
    left = first.select("slide_id", "hole", "area", (F.col("p.mx") - 1).alias("mx"), F.col("p.my").alias("my"))
    return left.join(labelled, ["slide_id", "mx", "my"]).select("slide_id", "hole", "area", F.col("component").alias("parent"))


def traced_areas(labelled: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Area inside the outer contour of each component, through the pixels' centres, less the contours of its holes.

    A square of four neighbouring centres lies inside by a whole if all four are of the component, by half if three are.
    """
    ends = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c))).alias(c)
    squares = labelled.select(*keys, "component", ends("mx"), "my").select(*keys, "component", "mx", ends("my"))
    inside = squares.groupBy(*keys, "component", "mx", "my").agg(F.count(F.lit(1)).alias("n"))
    return inside.groupBy(*keys, "component").agg(F.sum(F.when(F.col("n") == 4, 1.0).when(F.col("n") == 3, 0.5).otherwise(0.0)).alias("area"))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of structs (x, y)."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, after, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double"))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def roi_boxes(labelled: DataFrame, scale: int, margin: int, edge: int, bottom: int | None = None) -> DataFrame:
    """Boxes of components, enlarged to the target raster of edge x bottom (edge x edge if not stated) with a margin, as half-open intervals."""
    box = areas(labelled)
    low = lambda c: F.greatest(F.col(c) * scale - margin, F.lit(0)).cast("bigint")
    high = lambda c, most: F.least((F.col(c) + 1) * scale + margin, F.lit(most)).cast("bigint")
    return box.select("slide_id", "component", low("x0").alias("x0"), low("y0").alias("y0"), high("x1", edge).alias("x1"), high("y1", bottom or edge).alias("y1"))


def overlapping(boxes: DataFrame) -> DataFrame:
    """Pairs of boxes of a slide that share a pixel, found through square cells rather than all pairs."""
    cell = 64
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
    cells = boxes.withColumn("_cx", spread("x0", "x1")).withColumn("_cy", spread("y0", "y1"))
    other = cells.select("slide_id", "_cx", "_cy", F.col("component").alias("other"), *(F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")))
    meet = (F.col("component") < F.col("other")) & (F.col("x0") < F.col("ox1")) & (F.col("ox0") < F.col("x1")) & (F.col("y0") < F.col("oy1")) & (F.col("oy0") < F.col("y1"))
    return cells.join(other, ["slide_id", "_cx", "_cy"]).where(meet).select("slide_id", "component", "other").distinct()


def by_size(labelled: DataFrame) -> DataFrame:
    """Rank of components in their slide, largest first."""
    return areas(labelled).withColumn("rank", F.row_number().over(W.partitionBy("slide_id").orderBy(F.desc("area"), "component")))
