"""Greedy read plans in regions against going through the tiles one by one."""

import numpy as np
import pytest
from gridquarry.operators import supertiles


def one_by_one(tiles, step, sizes):
    """(st_id, block_size, ax, ay, pos, tile_index) of one slide."""
    free = {(x, y): k for k, (x, y) in enumerate(sorted(tiles))}
    rows, st = [], 0
    for size in [*sorted(sizes, reverse=True), 1]:
        for x, y in list(free):
            block = [(x + i * step, y + j * step) for i in range(size) for j in range(size)]
            if all(p in free for p in block):
                rows += [(st, size, x, y, pos, free.pop(p)) for pos, p in enumerate(block)]
                st += 1
    return sorted(rows)


@pytest.mark.parametrize(("region", "sizes"), [(5, (4, 2)), (16, (3, 2))])
def test_regions_equal_the_order_of_tiles(spark, region, sizes):
    rng = np.random.default_rng(region)
    slides = {
        1: [(x * 10, y * 10) for x in range(14) for y in range(11) if rng.random() < 0.9],
        2: [(x * 10 + (x > 6) * 3, y * 10) for x in range(12) for y in range(9)],
        3: [(0, 0)],
        4: [(x * 10, y * 10) for x in range(12) for y in range(12) if x + y < 15],
    }
    rows = [(s, k, x, y) for s, tiles in slides.items() for k, (x, y) in enumerate(sorted(tiles))]
    found = supertiles.greedy(spark.createDataFrame(rows, "slide_id bigint, tile_index int, x bigint, y bigint"), 10, sizes, region).collect()
    for s, tiles in slides.items():
        assert sorted((r.st_id, r.block_size, r.ax, r.ay, r.pos, r.tile_index) for r in found if r.slide_id == s) == one_by_one(tiles, 10, sizes)


def test_no_tiles(spark):
    assert supertiles.greedy(spark.createDataFrame([], "slide_id bigint, tile_index int, x bigint, y bigint"), 10).collect() == []
