"""Masks from reads of boxes against masks of the whole raster."""

import numpy as np
from gridquarry.operators import coarse
from gridquarry.sources.artifacts import png


def test_boxes_alone_are_read_and_judged_as_the_whole_would_be(spark, tmp_path):
    rng = np.random.default_rng(1)
    slides, whole = [], {}
    for k, (height, width) in enumerate([(90, 130), (61, 47)]):
        image = rng.integers(235, 256, (height, width, 1)).repeat(3, axis=2)
        for y, x in ((10, 8), (40, 20), (45, 100)):
            image[y : y + 14, x : x + 16] = [180, 60, 200]
        image[rng.random((height, width)) < 0.05] = [90, 90, 90]
        (tmp_path / f"{k}.png").write_bytes(png(image))
        slides.append((k, str(tmp_path / f"{k}.png"), "pil", 0.5))
        whole[k] = image
    slides += [(8, "/nowhere.png", "pil", 0.5)]
    frame = spark.createDataFrame(slides, "slide_id bigint, image_path string, backend string, base_spacing_um double")
    for sigma in (0.0, 0.6):
        runs, reads, errors = coarse.masks(frame, 0.5, 2.0, 3.0, sigma, cell=32)
        assert {r.slide_id: "cannot open" in r.error for r in errors.collect()} == {8: True}
        found = {k: np.zeros(image.shape[:2], bool) for k, image in whole.items()}
        for r in coarse.pixels_of(runs).collect():
            found[r.slide_id][r.my, r.mx] = True
        n = {k: sum(r.n_read for r in reads.where(f"slide_id = {k}").collect()) for k in whole}
        for k, image in whole.items():
            small = coarse.in_range(coarse.smoothed(image[np.arange(round(image.shape[0] / 4)) * image.shape[0] // round(image.shape[0] / 4)][:, np.arange(round(image.shape[1] / 4)) * image.shape[1] // round(image.shape[1] / 4)].astype(np.uint8), sigma / 2.0))
            inside = np.zeros(image.shape[:2], bool)
            for group in boxes_of(small):
                (y0, x0), (y1, x1) = group
                fx, fy = image.shape[1] / small.shape[1], image.shape[0] / small.shape[0]
                inside[max(int(y0 * fy) - 6, 0) : int(np.ceil((y1 + 1) * fy)) + 6, max(int(x0 * fx) - 6, 0) : int(np.ceil((x1 + 1) * fx)) + 6] = True
            want = coarse.in_range(coarse.smoothed(image.astype(np.uint8), sigma / 0.5)) & inside
            assert (found[k] == want).all() and want.any()
            assert n[k] < image.shape[0] * image.shape[1]


def boxes_of(mask):
    """The corners of 8-connected components."""
    todo, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
    while todo:
        group, more = [], [todo.pop()]
        while more:
            y, x = more.pop()
            group.append((y, x))
            beside = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & todo
            todo -= beside
            more += beside
        out.append(tuple((f(p[0] for p in group), f(p[1] for p in group)) for f in (min, max)))
    return out
