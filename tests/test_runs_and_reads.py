"""Runs over many slides, reads of slides, neighbourhood filters, previews: small cases against plain versions."""

import io
import json
import tarfile

import numpy as np
import pytest
from gridquarry import __main__ as cli
from gridquarry import batch
from gridquarry.operators import qc, rendering, runs, tiling
from gridquarry.operators import segmentation as seg
from gridquarry.sources import slides as sl
from gridquarry.sources.artifacts import encoder, png, record_archives
from gridquarry.sources.rasters import decode_png
from gridquarry.streaming.records import record_pixels, tile_records
from pyspark.sql import functions as F


def table(values, column="v"):
    return [(1, x, y, int(values[y, x])) for y in range(values.shape[0]) for x in range(values.shape[1])], f"slide_id bigint, x bigint, y bigint, {column} int"


def grid_of(rows, shape, column):
    out = np.zeros(shape, int)
    for r in rows:
        out[r["y"], r["x"]] = r[column]
    return out


@pytest.mark.parametrize("block", [5, 64])
def test_neighbourhood_filters(spark, block):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 256, (17, 23))
    frame = spark.createDataFrame(*table(values))
    wide = np.pad(values, 3, mode="edge")
    want = np.array([[np.sort(wide[y : y + 7, x : x + 7].ravel())[24] for x in range(23)] for y in range(17)])
    assert (grid_of(seg.median(frame, "v", 3, block=block).collect(), values.shape, "median") == want).all()
    k = np.exp(-0.5 * (np.arange(-2, 3) / 0.8) ** 2)
    k /= k.sum()
    wide = np.pad(values, 2, mode="reflect").astype(float)
    want = np.rint(np.array([[k @ wide[y : y + 5, x : x + 5] @ k for x in range(23)] for y in range(17)]))
    assert np.abs(grid_of(seg.gaussian(frame, "v", 0.8, block=block).collect(), values.shape, "v") - want).max() == 0
    mask = (values > 128).astype(int)
    got = grid_of(seg.morphed(spark.createDataFrame(*table(mask)), 2, "de", block=block).collect(), values.shape, "v")
    moves = seg.ellipse(2).tolist()
    inside = lambda m, y, x: 0 <= y < 17 and 0 <= x < 23
    big = np.array([[max(mask[y + a, x + b] for a, b in moves if inside(mask, y + a, x + b)) for x in range(23)] for y in range(17)])
    assert (got == np.array([[min(big[y + a, x + b] for a, b in moves if inside(mask, y + a, x + b)) for x in range(23)] for y in range(17)])).all()


def test_closing_with_even_and_odd_sides(spark):
    mask = (np.random.default_rng(2).random((9, 11)) < 0.3).astype(int)
    rows = [(1, x, y, int(mask[y, x])) for y in range(9) for x in range(11)]
    frame = spark.createDataFrame(rows, "slide_id bigint, mx bigint, my bigint, v int")
    for size in (1, 3, 4):
        low, high = size // 2, size - size // 2
        cut = lambda m, y, x: m[max(0, y - low) : y + high, max(0, x - low) : x + high]  # noqa: B023, E731
        big = np.array([[cut(mask, y, x).max() for x in range(11)] for y in range(9)])
        want = np.array([[cut(big, y, x).min() for x in range(11)] for y in range(9)]) if size > 1 else mask
        got = {(r.mx, r.my): r.v for r in seg.closed(frame, size).collect()}
        assert all(got[x, y] == want[y, x] for x in range(11) for y in range(9))


def test_blur_looks_at_valid_pixels_only(spark):
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (6, 6))
    rows = [(t, x, y, *[int(grey[y, x])] * 3, t == 0 or (t == 1 and 1 <= x <= 4 and 2 <= y <= 4)) for t in range(3) for x in range(6) for y in range(6)]
    got = {r.t: r.blur for r in qc.blur(spark.createDataFrame(rows, "t int, x int, y int, r int, g int, b int, valid boolean"), ["t"]).collect()}

    def spread(g):
        p = np.pad(g.astype(float), 1, mode="reflect")
        return (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var()

    assert got[0] == pytest.approx(spread(grey))
    assert got[1] == pytest.approx(spread(grey[2:5, 1:5]))
    assert got[2] == float("inf")


class Pyramid:
    """Two levels; every pixel tells its place."""

    spacing_um = 0.5
    level_sizes = ((40, 24), (20, 12))

    def region(self, x, y, width, height, level):
        d = 2**level
        at_x, at_y = x // d + np.arange(width), y // d + np.arange(height)
        out = np.full((height, width, 3), 255, np.uint8)
        ok = ((at_y >= 0) & (at_y < 24 // d))[:, None] & ((at_x >= 0) & (at_x < 40 // d))[None, :]
        out[..., 0], out[..., 1] = np.where(ok, (at_x * d)[None, :] % 256, 255), np.where(ok, (at_y * d)[:, None] % 256, 255)
        return out


def test_slide_reads():
    slide = sl.Slide(Pyramid())
    assert slide.spacings == [0.5, 1.0]
    assert slide.plan(1.02) == sl.Plan(1, 1.0, True)
    assert slide.plan(0.9) == sl.Plan(0, 0.5, False)
    assert slide.plan(3.0) == sl.Plan(1, 1.0, False)
    assert slide.region_at(8, 4, 1.0, 4, 3)[0, 0].tolist() == [8, 4, 255]
    assert slide.region_at(0, 0, 0.75, 4, 4).shape == (4, 4, 3)
    assert slide.whole_at(2.0).shape == (6, 10, 3)
    assert slide.thumbnail(10, 10).shape == (6, 10, 3)
    with pytest.raises(ValueError, match="not enlarged"):
        slide.region_at(0, 0, 0.2, 4, 4)
    with pytest.raises(ValueError, match="colours"):
        slide.labels_at(0.5)
    with pytest.raises(ValueError, match="nearest"):
        slide.region_at(0, 0, 0.5, 2, 2, how="area", kind="label")
    with pytest.raises(ValueError, match="fractions"):
        sl.discrete(np.array([[0.5]]))
    assert sl.as_rgb(np.array([[0.0, 1.0]])).tolist() == [[[0] * 3, [255] * 3]]
    assert sl.as_rgb(np.zeros((2, 2, 4), np.uint16)).shape == (2, 2, 3)
    with pytest.raises(ValueError, match="mask .*try another"):
        sl.open_mask("/nowhere/mask.png", "pil", 1.0)


def test_resizing():
    a = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert sl.resized(a, 2, 2, "nearest").tolist() == [[0, 2], [8, 10]]
    assert sl.resized(a, 2, 2, "area").tolist() == [[2, 4], [10, 12]]
    assert sl.resized(a, 8, 8, "linear").shape == (8, 8)
    assert sl.resized(a, 8, 4, "nearest")[0].tolist() == [0, 0, 1, 1, 2, 2, 3, 3]


def test_tile_records_and_openability(spark, tmp_path):
    pixels = np.random.default_rng(4).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(pixels))
    rows = [(1, k, x, y, 8, str(tmp_path / "a.png"), "pil", 0.5) for k, (x, y) in enumerate([(0, 0), (8, 0), (24, 16)])]
    found = tile_records(spark.createDataFrame(rows, "slide_id bigint, tile_index int, x bigint, y bigint, tile int, image_path string, backend string, base_spacing_um double"), 0.5, 8)
    got = {r.tile_index: np.frombuffer(r.data, np.uint8).reshape(8, 8, 3) for r in found.collect()}
    assert (got[1] == pixels[:8, 8:16]).all()
    assert (got[2][:4, :6] == pixels[16:, 24:]).all()
    assert (got[2][4:] == 255).all()
    assert record_pixels(found).count() == 3 * 64
    archives = record_archives(found, part=2).orderBy("part").collect()
    assert [(r.part, r.n_tiles) for r in archives] == [(0, 2), (1, 1)]
    with tarfile.open(fileobj=io.BytesIO(bytes(archives[1].tar))) as tar:
        (member,) = tar.getmembers()
        assert member.name == "000002.png"
        assert (decode_png(tar.extractfile(member).read()) == got[2]).all()
    with pytest.raises(ValueError, match="unknown encoder"):
        encoder("bmp")
    limits = qc.Limits(white_share=0.3, black_share=None, grey_share=None, blur_least=None)
    tiles = spark.createDataFrame([(1, 0, 0, 8), (1, 24, 16, 8), (2, 0, 0, 8)], "slide_id bigint, x bigint, y bigint, tile int").withColumn("tile_index", F.lit(9))
    slides = spark.createDataFrame([(1, str(tmp_path / "a.png"), "pil", 0.5), (2, "/nowhere.png", "pil", 0.5)], "slide_id bigint, image_path string, backend string, base_spacing_um double")
    kept = tiling.checked_tiles(tiles, slides, limits, tiling.Spec(tile_px=8), 0.5).collect()
    assert sorted((r.slide_id, r.x, r.tile_index) for r in kept) == [(1, 0, 0), (1, 24, 1), (2, 0, 0)]  # what lies beyond the slide is no white pixel
    told = {r.image_path: r.ok for r in runs.openable(spark.createDataFrame([(str(tmp_path / "a.png"),), ("/nowhere.png",)], "image_path string")).collect()}
    assert told == {str(tmp_path / "a.png"): True, "/nowhere.png": False}


def test_images(spark):
    rows = [(1, x, y, x * 10, y * 10, 7) for x in range(5) for y in range(3)]
    (r,) = rendering.images(spark.createDataFrame(rows, "slide_id bigint, x bigint, y bigint, r int, g int, b int")).collect()
    assert (r.width, r.height) == (5, 3)
    assert decode_png(bytes(r.image))[2, 4].tolist() == [40, 20, 7]


def test_input_order_numbers_all_rows(spark):
    n = 2500
    manifest = spark.range(n).selectExpr("id row_id", "concat('s', id) sample_id")
    results = spark.range(n).selectExpr("concat('s', id) sample_id", "cast(null as string) annotation")
    got = runs.input_order(results, manifest).collect()
    assert sorted(r.out_index for r in got) == list(range(n))
    assert all(r.out_index == r.input_index for r in got)


@pytest.fixture
def inputs(spark, tmp_path):
    (tmp_path / "manifest.csv").write_text("sample_id,image_path,mask_path,spacing_at_level_0\na,/x/a.svs,,\nb,/x/b.svs,,0.5\ngone,/x/gone.svs,,\nfine,/x/f.svs,,2.0\nempty,/x/e.svs,,\n")
    sizes = [(s, k, 640 >> k, 320 >> k, um) for s, um in (("a", 0.5), ("b", 0.25), ("fine", 0.5), ("empty", 0.5)) for k in range(2)]
    spark.createDataFrame(sizes, "sample_id string, level int, width bigint, height bigint, base_spacing_um double").coalesce(1).write.parquet(str(tmp_path / "pyramids"))
    mask = [(s, x, y, 1 + (x >= 10)) for s in ("a", "b") for x in range(2, 18) for y in range(2, 8)]
    spark.createDataFrame(mask, "sample_id string, mx bigint, my bigint, label int").coalesce(1).write.parquet(str(tmp_path / "masks"))
    return {"manifest": str(tmp_path / "manifest.csv"), "pyramids": str(tmp_path / "pyramids"), "masks": str(tmp_path / "masks"), "out": str(tmp_path / "out"), "mask_size": [20, 10], "tiling": {"tile_px": 64, "spacing_um": 0.5}}


def test_command_line(spark, inputs, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({**inputs, "out": "elsewhere"}))
    with pytest.warns(batch.PartialFailure, match="2 slides failed"):
        assert cli.main(["--config", str(tmp_path / "run.json"), f"out={inputs['out']}"], spark) == 1
    rows = {r.sample_id: r for r in spark.read.option("header", True).csv(f"{inputs['out']}/process_list").collect()}
    assert {k: r.tiling_status for k, r in rows.items()} == {"a": "success", "b": "success", "empty": "success", "gone": "failed", "fine": "failed"}
    assert "cannot open" in rows["gone"].error
    assert rows["empty"].num_tiles == "0"
    tiles = spark.read.parquet(f"{inputs['out']}/coordinates")
    assert {r.slide_id: r["count"] for r in tiles.groupBy("slide_id").count().collect()} == {k: int(r.num_tiles) for k, r in rows.items() if r.num_tiles != "0"}
    assert tiles.where("slide_id = 'a'").agg({"x": "min"}).first()[0] == 64
    with pytest.raises(SystemExit):
        cli.main(["out=x"], spark)


def test_resume_and_annotations(spark, inputs):
    with pytest.warns(batch.PartialFailure):
        batch.run(spark, inputs)
    again = {**inputs, "resume": f"{inputs['out']}/process_list", "out": inputs["out"] + "2"}
    with pytest.warns(batch.PartialFailure):
        assert batch.run(spark, again) == 2
    assert spark.read.option("header", True).csv(f"{again['out']}/process_list").count() == 5
    for strategy in ("independent", "joint"):
        own = {**inputs, "labels": {"left": [1, 0.5], "right": [2, None]}, "strategy": strategy, "out": f"{inputs['out']}-{strategy}"}
        with pytest.warns(batch.PartialFailure):
            batch.run(spark, own)
        names = {r.annotation for r in spark.read.parquet(f"{own['out']}/coordinates").select("annotation").distinct().collect()}
        assert names == {"left", "right"}


def test_twice_listed_slides_and_unknown_words_are_refused(spark):
    with pytest.raises(ValueError, match="more than once"):
        batch.checked(spark.createDataFrame([("a",), ("a",)], "sample_id string"))
    with pytest.raises(ValueError, match="unknown strategy"):
        tiling.per_annotation(None, None, None, 1, 1, tiling.Spec(), "other")
    with pytest.raises(ValueError, match="unknown segmentation"):
        seg.segmented(spark.createDataFrame([(1, 0, 0, 1, 1, 1)], "slide_id int, x int, y int, r int, g int, b int"), "other")
