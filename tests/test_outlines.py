"""Followed borders: order, areas and fillings, in blocks and at once."""

import numpy as np
import pytest
from gridquarry.operators import components as cc
from gridquarry.operators import outlines


@pytest.mark.parametrize("block", [4, 64])
def test_points_are_in_order_and_close(spark, block):
    rng = np.random.default_rng(5)
    masks = {1: rng.random((17, 23)) < 0.6, 2: np.ones((17, 23), bool), 3: np.zeros((17, 23), bool)}
    masks[3][3, 5], masks[3][8:13, 2:9], masks[3][10, 4:6] = True, True, False
    rows = [(s, int(x), int(y)) for s, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    labelled = cc.components(spark.createDataFrame(rows, "slide_id bigint, mx bigint, my bigint"), 23, block, height=17)
    borders = outlines.sides(labelled, 23, 17, block=block).persist()
    loops = {}
    for r in borders.collect():
        loops.setdefault((r.slide_id, r.loop), []).append((r.place, r.mx, r.my, r.heading, r.nx, r.ny))
    for own in loops.values():
        own.sort()
        assert [r[0] for r in own] == list(range(len(own)))
        assert all((a[4], a[5]) == (b[1], b[2]) for a, b in zip(own, own[1:] + own[:1], strict=True))
    told = {(r.slide_id, r.loop): r for r in outlines.contours(borders).collect()}
    listed = {}
    for r in outlines.points(borders).collect():
        listed.setdefault((r.slide_id, r.loop), []).append((r.place, r.x, r.y))
    assert set(listed) == set(told) == set(loops)
    for key, own in listed.items():
        at = [p[1:] for p in sorted(own)]
        assert len(at) == told[key].n_points
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(at, at[1:] + at[:1], strict=True)) or len(at) == 1
        assert abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(at, at[1:] + at[:1], strict=True))) / 2 == told[key].area
    want = {(r.slide_id, r.component): r.area for r in cc.traced_areas(labelled).collect()}
    assert {(r.slide_id, r.component): r.area for r in outlines.net_areas(outlines.contours(borders)).collect()} == want
    assert {r.loop: r.is_hole for r in told.values() if r.slide_id == 3} and sum(r.is_hole for r in told.values() if r.slide_id == 3) == 1
