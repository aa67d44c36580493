"""Raster queries over whole inputs, against brute force."""

from collections import defaultdict

import pytest
from gridquarry.plans import QUERIES
from gridquarry.plans.fixtures import SIDE, Fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def masks(spark):
    out = defaultdict(set)
    for r in Fixtures(spark, SF).mask_px.collect():
        out[r.slide_id].add((r.mx, r.my))
    assert max(x for m in out.values() for x, _ in m) == SIDE - 1
    return out


def flooded(pixels):
    """Pixel to the smallest my * SIDE + mx of its 8-connected component."""
    left, out = set(pixels), {}
    while left:
        todo, own = [left.pop()], []
        while todo:
            x, y = todo.pop()
            own.append((x, y))
            for p in [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
        out |= dict.fromkeys(own, min(y * SIDE + x for x, y in own))
    return out


def grouped(labels):
    out = defaultdict(list)
    for p, k in labels.items():
        out[k].append(p)
    return out


def holes_of(mask):
    back = flooded({(x, y) for x in range(SIDE) for y in range(SIDE)} - mask)
    return {k: px for k, px in grouped(back).items() if all(0 < c < SIDE - 1 for p in px for c in p)}


def found(spark, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect())


def test_holes_of_whole_masks(spark, masks):
    filled, holes = set(), []
    for s, mask in masks.items():
        front = flooded(mask)
        filled |= {(s, *p) for p in mask}
        for k, px in holes_of(mask).items():
            holes.append((s, k, len(px), front[k % SIDE - 1, k // SIDE]))
            if len(px) <= 3:
                filled |= {(s, *p) for p in px}
    assert found(spark, "fill_small_holes_whole", "slide_id", "mx", "my") == sorted(filled)
    assert found(spark, "contour_holes_whole", "slide_id", "hole", "area", "parent") == sorted(holes)
    assert any(k % SIDE >= 16 and k // SIDE >= 16 for _, k, *_ in holes)


TURNS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def walked(pixels, start, came):
    """Shoelace area of the border walked along pixels, from one whose neighbour in direction `came` is not of them."""
    path, at, first = [], start, None
    while True:
        step = next((k % 8 for k in range(came + 1, came + 9) if (at[0] + TURNS[k % 8][0], at[1] + TURNS[k % 8][1]) in pixels), None)
        if step is None or (at, step) == first:
            break
        first = first or (at, step)
        path.append(at)
        at, came = (at[0] + TURNS[step][0], at[1] + TURNS[step][1]), (step + 4) % 8
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(path, path[1:] + path[:1], strict=True))) / 2


def net_area(pixels):
    """Walked around the pixels, less the border walked along them inside each hole."""
    own = set(pixels)
    x0, y0, x1, y1 = min(x for x, _ in own) - 1, min(y for _, y in own) - 1, max(x for x, _ in own) + 1, max(y for _, y in own) + 1
    left, parts = {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} - own, []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            x, y = todo.pop()
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in left:
                    left.remove(p)
                    part.add(p)
                    todo.append(p)
        if (x0, y0) not in part:
            parts.append(part)
    top = lambda px: min(px, key=lambda p: (p[1], p[0]))
    return walked(own, top(own), 4) - sum(walked(own, (top(h)[0] - 1, top(h)[1]), 0) for h in parts)


def test_areas_by_hand(spark):
    from gridquarry.operators import components as cc

    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    shapes = {1: ring, 2: [(x, 0) for x in range(5)], 3: [(0, 0), (1, 0), (0, 1)], 4: [(x, y) for x in range(4) for y in range(3)], 5: [(7, 7)]}
    mask = spark.createDataFrame([(s, x, y) for s, px in shapes.items() for x, y in px], "slide_id bigint, mx bigint, my bigint")
    got = {r.slide_id: r.area for r in cc.traced_areas(cc.components(mask, 9)).collect()}
    assert got == {1: 2.0, 2: 0.0, 3: 0.5, 4: 6.0, 5: 0.0} == {s: net_area(px) for s, px in shapes.items()}


def test_components_of_whole_masks(spark, masks):
    labels = {s: flooded(m) for s, m in masks.items()}
    parts = {(s, k): px for s, own in labels.items() for k, px in grouped(own).items()}
    assert max(len(px) for px in parts.values()) > 16
    assert found(spark, "contour_components_whole", "slide_id", "mx", "my", "component") == sorted((s, *p, k) for s, own in labels.items() for p, k in own.items())
    assert found(spark, "remove_small_components_whole", "slide_id", "mx", "my", "component") == sorted((s, *p, k) for (s, k), px in parts.items() if len(px) >= 4 for p in px)

    def box(px, margin):
        xs, ys = [x for x, _ in px], [y for _, y in px]
        return max(min(xs) * 4 - margin, 0), max(min(ys) * 4 - margin, 0), min((max(xs) + 1) * 4 + margin, 128), min((max(ys) + 1) * 4 + margin, 128)

    assert found(spark, "roi_boxes_whole", "slide_id", "component", "x0", "y0", "x1", "y1") == sorted((*k, *box(px, 2)) for k, px in parts.items())
    wide = {k: box(px, 10) for k, px in parts.items()}
    meet = [(s, a, b) for (s, a), p in wide.items() for (t, b), q in wide.items() if s == t and a < b and p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3]]
    assert found(spark, "roi_overlaps_whole", "slide_id", "component", "other") == sorted(meet)
    assert found(spark, "contour_area_whole", "slide_id", "component", "area") == sorted((*k, net_area(px)) for k, px in parts.items())
    ranks = [(s, k, len(parts[s, k]), n + 1) for s in masks for n, k in enumerate(sorted((k for t, k in parts if t == s), key=lambda k: (-len(parts[s, k]), k)))]
    assert found(spark, "component_rank_whole", "slide_id", "component", "area", "rank") == sorted(ranks)


def test_pixel_queries_see_all_slides(spark):
    sf = "/root/testdata/sf0.01"
    slides = {r.slide_id for r in Fixtures(spark, sf).slides.collect()}
    assert len(slides) > 20
    got = Fixtures(spark, sf).raster_px.collect()
    assert len({(r.slide_id, r.x, r.y) for r in got}) == len(got) == len(slides) * SIDE * SIDE
    for name in ("qc_white_whole", "seg_otsu_whole"):
        assert {r.slide_id for r in QUERIES[name](spark, sf).collect()} == slides
