"""Filters over blocks of many small rasters."""

import numpy as np

from gridquarry.operators import segmentation as seg


def test_blocks_are_worked_on_many_at_once(spark):
    values = spark.createDataFrame([(k, x, y, 1) for k in range(60) for x in range(6) for y in range(4)], "slide_id bigint, x bigint, y bigint, v int")
    count = lambda whole: np.full_like(whole, whole.shape[1] if whole.ndim == 4 else 1)
    out = seg.over_blocks(values, "v", 0, count, "int", block=4).collect()
    assert len(out) == 60 * 24 and max(r["v"] for r in out) > 5
    assert {(r["x"], r["y"]) for r in out} == {(x, y) for x in range(6) for y in range(4)}
