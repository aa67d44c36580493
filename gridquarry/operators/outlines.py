"""Contours as lists of points: borders followed in blocks and stitched where they leave them.

A pixel of a mask has a side on the border for each of its four neighbours that
is not of the mask.  Sides have a direction, the mask on their right, and each is
followed by exactly one other (left before straight before right, so that pixels
that touch by a corner hang together); so they fall into loops: one around each
component, and one, turning the other way, around each of its holes.

Sides are followed inside blocks by pointer doubling.  What enters and leaves a
block is a segment; segments are linked to loops and ranked by joins, in as many
rounds as the logarithm of a loop's segments.  Places are numbers in rows, so no
task ever holds a contour.  The points of a contour are the pixels its sides
belong to, each run of one pixel once; the next point is in the same row, so
areas need no order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.operators import components as cc
from gridquarry.operators import links
from gridquarry.shared import stored, unstored

#: Headings east, south, west, north: the way along a side of a pixel, and the neighbour beyond that side.
ALONG = ((1, 0), (0, 1), (-1, 0), (0, -1))
BEYOND = ((0, -1), (1, 0), (0, 1), (-1, 0))


def _ranked(after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, rank, last) of each node in its chain; after: the next node or -1.  A ring is cut before its smallest node."""
    n = len(after)
    after = after.copy()
    jump, rounds = np.where(after >= 0, after, np.arange(n)), max(1, n.bit_length())
    for _ in range(rounds):
        jump = jump[jump]
    ring = after[jump] >= 0
    low, hop = np.arange(n), np.where(ring, after, np.arange(n))
    for _ in range(rounds):
        low = np.minimum(low, low[hop])
        hop = hop[hop]
    cut = np.flatnonzero(ring & (after == low))
    after[cut] = -1
    jump, left = np.where(after >= 0, after, np.arange(n)), (after >= 0).astype(np.int64)
    for _ in range(rounds):
        left = left + left[jump]
        jump = jump[jump]
    begins = np.ones(n, bool)
    begins[after[after >= 0]] = False
    first = np.empty(n, np.int64)
    first[jump[begins]] = np.flatnonzero(begins)
    first = first[jump]
    return first, left[first] - left, jump


def _followed(width: int, height: int, keys: tuple[str, ...]):
    """Sides of the pixels of whole blocks, each with its segment (the number of the side that it enters by), its rank there, the segment's length, and the side that follows the segment (-1 for a loop)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in cc._whole_groups(batches, [*keys, "_bx", "_by"]):
            mx, my = cc._integers(rows, "mx", "my")
            wide, tall = width + 2, height + 2
            code = (group * tall + my + 1) * wide + mx + 1
            order = np.argsort(code)
            code, group, mx, my = code[order], group[order], mx[order], my[order]
            own = rows["own"].to_numpy(zero_copy_only=False)[order]

            def at(dx, dy, code=code, wide=wide):
                """The place of the pixel at an offset, or -1."""
                other = code + dy * wide + dx
                found = np.minimum(np.searchsorted(code, other), len(code) - 1)
                return np.where(code[found] == other, found, -1)

            pixel, heading, onto, turned = [], [], [], []
            for d in range(4):
                (hx, hy), (bx, by) = ALONG[d], BEYOND[d]
                sides = np.flatnonzero(own & (at(bx, by) < 0))
                left, straight = at(hx + bx, hy + by)[sides], at(hx, hy)[sides]
                pixel.append(sides)
                heading.append(np.full(len(sides), d))
                onto.append(np.where(left >= 0, left, np.where(straight >= 0, straight, sides)))
                turned.append(np.where(left >= 0, (d + 3) % 4, np.where(straight >= 0, d, (d + 1) % 4)))
            pixel, heading, onto, turned = (np.concatenate(x) for x in (pixel, heading, onto, turned))
            if not len(pixel):
                continue
            number = np.full(4 * len(code), -1)
            number[4 * pixel + heading] = np.arange(len(pixel))
            name = lambda p, d: 4 * (my[p] * width + mx[p]) + d  # noqa: B023, E731
            # sides in order of their names, so that the smallest of a ring is its name
            first, rank, last = _ranked(number[4 * onto + turned])
            names, following = name(pixel, heading), name(onto, turned)
            closed = following[last] == names[first]
            length = rank[last] + 1
            take = pa.array(order[pixel])
            values = (names[first], rank, length, np.where(closed, -1, following[last]), mx[pixel], my[pixel], heading, mx[onto], my[onto])
            yield from pa.table([*(rows[c].take(take) for c in (*keys, "component")), *(pa.array(v.astype(np.int64)) for v in values)], names=[*keys, "component", "segment", "rank", "length", "follows", "mx", "my", "heading", "nx", "ny"]).to_batches()

    return run


def sides(labelled: DataFrame, width: int, height: int, keys: tuple[str, ...] = cc.KEYS, block: int | None = None) -> DataFrame:
    """labelled: keys..., mx, my, component.  All sides of its borders: keys..., component, loop, place (ascending along the loop), mx, my, heading, and nx, ny, the pixel of the side that follows."""
    block = block or cc.BLOCK
    near = lambda c, edge: F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.least(F.greatest(F.col(c) + o, F.lit(0)), F.lit(edge - 1)) / block))))
    own = labelled.select(*keys, "component", "mx", "my").withColumn("_bx", near("mx", width)).withColumn("_by", near("my", height))
    own = own.withColumn("own", (F.col("_bx") == F.floor(F.col("mx") / block)) & (F.col("_by") == F.floor(F.col("my") / block)))
    kinds = dict(labelled.dtypes)
    told = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "component")) + ", segment bigint, rank bigint, length bigint, follows bigint, mx bigint, my bigint, heading bigint, nx bigint, ny bigint"
    found = stored(own.repartition(*keys, "_bx", "_by").sortWithinPartitions(*keys, "_bx", "_by").mapInArrow(_followed(width, height, keys), told), "sides")
    at = _loops(found.where("rank = 0 and follows >= 0").select(*keys, "segment", "length", "follows"), keys)
    placed = found.join(at, [*keys, "segment"], "left")
    return placed.select(*keys, "component", F.coalesce("loop", "segment").alias("loop"), (F.coalesce("before", F.lit(0)) + F.col("rank")).alias("place"), "mx", "my", "heading", "nx", "ny")


def _loops(segments: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys..., segment, loop (its smallest segment) and before, how many sides of the loop come before the segment."""
    node = lambda c: F.struct(*keys, F.col(c).alias("segment"))
    roots = links.components(segments.select(node("segment").alias("a"), node("follows").alias("b"))).select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.segment").alias("segment"), F.col("root.segment").alias("loop"))
    to = F.when(F.col("follows") != F.col("loop"), F.col("follows"))
    ahead = stored(segments.join(roots, [*keys, "segment"], "left").withColumn("loop", F.coalesce("loop", "segment")).select(*keys, "segment", "loop", to.alias("to"), F.col("length").alias("left")), "ahead")
    while not ahead.where("to is not null").isEmpty():
        there = ahead.select(*keys, F.col("segment").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"))
        after = stored(ahead.join(there, [*keys, "to"], "left").select(*keys, "segment", "loop", F.col("_to").alias("to"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")), "ahead")
        unstored(ahead)
        ahead = after
    whole = ahead.where("segment = loop").select(*keys, "loop", F.col("left").alias("_all"))
    return ahead.join(whole, [*keys, "loop"]).select(*keys, "segment", "loop", (F.col("_all") - F.col("left")).alias("before"))


def contours(borders: DataFrame, keys: tuple[str, ...] = cc.KEYS) -> DataFrame:
    """By loop of `sides`: keys..., component, loop, is_hole, n_points and area, that of the polygon through its points.  The parent of a hole is its component's own loop."""
    x1, y1 = (F.col(c) + sum(F.when(F.col("heading") == d, ALONG[d][k] + _corner(d)[k]).otherwise(0) for d in range(4)) for k, c in enumerate(("mx", "my")))
    x0, y0 = (F.col(c) + sum(F.when(F.col("heading") == d, _corner(d)[k]).otherwise(0) for d in range(4)) for k, c in enumerate(("mx", "my")))
    turn = x0 * y1 - x1 * y0
    moved = F.col("mx") * F.col("ny") - F.col("nx") * F.col("my")
    is_point = (F.col("mx") != F.col("nx")) | (F.col("my") != F.col("ny"))
    found = borders.groupBy(*keys, "component", "loop").agg((F.sum(turn) < 0).alias("is_hole"), F.greatest(F.count_if(is_point), F.lit(1)).alias("n_points"), (F.abs(F.sum(moved)) / 2).alias("area"))
    return found


def _corner(d: int) -> tuple[int, int]:
    """Where a side begins, from its pixel's upper left corner."""
    return ((0, 0), (1, 0), (1, 1), (0, 1))[d]


def points(borders: DataFrame, keys: tuple[str, ...] = cc.KEYS) -> DataFrame:
    """keys..., component, loop, place, x, y: the points of each contour in ascending place; a pixel by itself is one point."""
    lone = F.count_if((F.col("mx") != F.col("nx")) | (F.col("my") != F.col("ny"))).over(W.partitionBy(*keys, "component", "loop")) == 0
    small = borders.join(borders.groupBy(*keys, "component", "loop").agg(F.count(F.lit(1)).alias("_n")).where("_n = 4"), [*keys, "component", "loop"]).withColumn("_lone", lone).where("_lone and place = 0")
    moving = borders.where("mx <> nx or my <> ny")
    columns = [*keys, "component", "loop", "place", F.col("mx").alias("x"), F.col("my").alias("y")]
    return moving.select(columns).unionByName(small.select(columns))


def net_areas(found: DataFrame, keys: tuple[str, ...] = cc.KEYS) -> DataFrame:
    """keys..., component, area: of `contours`, the outer polygon's less those of the holes."""
    return found.groupBy(*keys, "component").agg(F.sum(F.when(F.col("is_hole"), -F.col("area")).otherwise(F.col("area"))).alias("area"))


def filled(borders: DataFrame, keys: tuple[str, ...] = cc.KEYS) -> DataFrame:
    """keys..., component, y, x0, x1 (exclusive): what the outer loops enclose, line by line, from their upright sides."""
    outer = contours(borders, keys).where(~F.col("is_hole")).select(*keys, "component", "loop")
    upright = borders.where("heading in (1, 3)").join(outer, [*keys, "component", "loop"])
    line = W.partitionBy(*keys, "component", "my", "heading").orderBy("mx")
    nth = upright.withColumn("_k", F.row_number().over(line))
    ends = nth.where("heading = 1").select(*keys, "component", "my", "_k", (F.col("mx") + 1).alias("x1"))
    return nth.where("heading = 3").join(ends, [*keys, "component", "my", "_k"]).select(*keys, "component", F.col("my").alias("y"), F.col("mx").alias("x0"), "x1")
