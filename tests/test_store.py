"""Runs into one folder: resuming, replacing, crashes, broken slides, files that belong together."""

import json
import os
import shutil
import tarfile

import numpy as np
import pytest
from gridquarry import archives, batch, outcomes, store
from gridquarry.sources import artifacts, file_sets
from gridquarry.sources.artifacts import png
from gridquarry.sources.rasters import decode_png
from pyspark.sql import functions as F

pytestmark = pytest.mark.filterwarnings("ignore::gridquarry.batch.PartialFailure")


def listed(tmp_path, samples, spacing=None):
    lines = [f"{s},{tmp_path}/{s}.png,{tmp_path}/{s}-mask.png,{(spacing or {}).get(s, 0.5)}" for s in samples]
    (tmp_path / "manifest.csv").write_text("\n".join(["sample_id,image_path,mask_path,spacing_at_level_0", *lines]) + "\n")


def grey_png(labels):
    return png(np.repeat(labels[:, :, None], 3, axis=2).astype(np.uint8))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A folder with slides, masks and a first run over them."""
    top = tmp_path_factory.mktemp("runs")
    rng = np.random.default_rng(1)
    for s in ("a", "b", "c"):
        (top / f"{s}.png").write_bytes(png(rng.integers(0, 256, (80, 160, 3))))
        mask = np.zeros((10, 20), int)
        mask[1:9, 2:10], mask[1:9, 10:18] = 1, 2
        (top / f"{s}-mask.png").write_bytes(grey_png(mask))
    listed(top, "abc")
    settings = {"manifest": str(top / "manifest.csv"), "out": str(top / "out"), "mask_size": [20, 10], "tiling": {"tile_px": 16, "spacing_um": 0.5}}
    assert batch.run(spark, settings) == 0
    shutil.copytree(top, f"{top}-kept")
    return top, settings


@pytest.fixture
def inputs(base):
    """As after the first run, whatever another test has done."""
    top, settings = base
    shutil.rmtree(top)
    shutil.copytree(f"{top}-kept", top)
    return dict(settings)


def state(spark, out):
    """Tiles by sample and annotation, table rows, and the files that are there; the three have to agree."""
    own = store.RunStore(spark, out)
    tiles = {}
    for r in own.tiles().collect():
        tiles.setdefault((r.slide_id, r.annotation), []).append((r.tile_index, r.x, r.y, round(r.frac, 5)))
    rows = {(r.sample_id, r.annotation): r for r in spark.read.option("header", True).csv(f"{out}/process_list").collect()}
    files = sorted(os.path.relpath(os.path.join(d, f), out) for d, _, names in os.walk(f"{out}/tiles") for f in names if not f.endswith(".crc"))
    done = {k: r for k, r in rows.items() if r.tiling_status == "success"}
    assert {k: len(v) for k, v in tiles.items()} == {k: int(r.num_tiles) for k, r in done.items() if r.num_tiles != "0"}
    assert files == sorted([r.coordinates_meta_path for r in done.values()] + [r.coordinates_npz_path for r in done.values() if r.coordinates_npz_path])
    for key, r in done.items():
        meta = json.load(open(f"{out}/{r.coordinates_meta_path}"))
        assert meta["tiling"]["n_tiles"] == int(r.num_tiles)
        if r.coordinates_npz_path:
            found = artifacts.from_npz(open(f"{out}/{r.coordinates_npz_path}", "rb").read())
            assert sorted(tiles[key])[0][:3] == tuple(found.iloc[0][["tile_index", "x", "y"]].astype(int))
    assert not os.path.exists(f"{out}/staging") and not os.path.exists(f"{out}/journal")
    return {k: sorted(v) for k, v in tiles.items()}, rows


def when(spark, out):
    """The folders of parts and when their files were written."""
    return {d: max(os.stat(os.path.join(d, f)).st_mtime_ns for f in names if f.endswith(".parquet")) for d, _, names in os.walk(f"{out}/coordinates") if any(f.endswith(".parquet") for f in names)}


def test_resume_into_the_same_folder_keeps_what_agrees(spark, inputs, base):
    tmp_path = base[0]
    first, _ = state(spark, inputs["out"])
    assert len(first) == 3
    before = when(spark, inputs["out"])
    assert batch.run(spark, {**inputs, "resume": True}) == 0
    again, _ = state(spark, inputs["out"])
    assert again == first and when(spark, inputs["out"]) == before  # nothing was written anew
    listed(tmp_path, "abc", {"b": 1.0})
    (tmp_path / "c.png").unlink()
    assert batch.run(spark, {**inputs, "tiling": {**inputs["tiling"], "spacing_um": 0.5}, "resume": True}) == 1
    mixed, rows = state(spark, inputs["out"])
    assert mixed[("a", "tissue")] == first[("a", "tissue")] and ("b", "tissue") not in mixed
    assert "not enlarged" in rows[("b", None)].error
    assert mixed[("c", "tissue")] == first[("c", "tissue")]  # it stands, so it is not opened
    assert batch.run(spark, {**inputs, "tiling": {"tile_px": 8, "spacing_um": 1.0}, "resume": True}) == 1
    small, rows = state(spark, inputs["out"])
    assert set(small) == {("a", "tissue"), ("b", "tissue")} and "cannot open" in rows[("c", None)].error
    fresh = {**inputs, "tiling": {"tile_px": 8, "spacing_um": 1.0}, "out": f"{inputs['out']}-fresh"}
    batch.run(spark, fresh)
    assert state(spark, fresh["out"])[0] == small


def test_only_failed_or_changed_annotations_are_made_again(spark, inputs):
    both = {**inputs, "labels": {"left": [1, 0.2], "right": [2, 0.2]}}
    assert batch.run(spark, {**both, "labels": {"left": [1, 0.2]}}) == 0
    left, _ = state(spark, inputs["out"])
    before = when(spark, inputs["out"])
    assert batch.run(spark, {**both, "resume": True}) == 0
    now, rows = state(spark, inputs["out"])
    assert {k: v for k, v in now.items() if k[1] == "left"} == left and len(rows) == 6
    assert {d: t for d, t in when(spark, inputs["out"]).items() if "annotation=left" in d} == before
    assert batch.run(spark, {**both, "strategy": "joint", "resume": True}) == 0
    joint, _ = state(spark, inputs["out"])
    assert set(joint) == set(now)


def test_slides_that_are_not_listed_keep_what_they_have(spark, inputs, base):
    tmp_path = base[0]
    first, _ = state(spark, inputs["out"])
    listed(tmp_path, "ab")
    assert batch.run(spark, {**inputs, "resume": True}) == 0
    assert state(spark, inputs["out"])[0] == first
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n and nothing more")
    (tmp_path / "b-mask.png").write_bytes(png(np.random.default_rng(2).integers(0, 256, (10, 20, 3))))
    listed(tmp_path, "abc")
    assert batch.run(spark, inputs) == 2  # without resume all is replaced; broken files end their slides only
    tiles, rows = state(spark, inputs["out"])
    assert set(tiles) == {("c", "tissue")}
    assert "colours" in rows[("b", None)].error
    assert "cannot open" in rows[("a", None)].error and rows[("a", None)].tiling_status == "failed"


def test_a_crash_before_the_journal_changes_nothing_and_one_after_it_is_carried_out(spark, inputs, tmp_path, monkeypatch):
    first, _ = state(spark, inputs["out"])
    changed = {**inputs, "tiling": {"tile_px": 8, "spacing_um": 0.5}, "resume": True}
    written = store.Files.write

    def dies(self, path, text):
        if path.endswith("change.json"):
            raise RuntimeError("lost")
        written(self, path, text)

    monkeypatch.setattr(store.Files, "write", dies)
    with pytest.raises(RuntimeError, match="lost"):
        batch.run(spark, changed)
    monkeypatch.setattr(store.Files, "write", written)
    assert not store.RunStore(spark, inputs["out"]).recover()
    assert state(spark, inputs["out"])[0] == first
    shutil.copytree(inputs["out"], tmp_path / "copy")
    moved, moves = store.Files.move, []

    for at in (1, 4):  # the change is cut short at several places
        shutil.rmtree(inputs["out"])
        shutil.copytree(tmp_path / "copy", inputs["out"])
        moves.clear()

        def stops(self, source, target, at=at):
            if not source.endswith(".new"):
                moves.append(source)
                if len(moves) == at:
                    raise RuntimeError("lost")
            moved(self, source, target)

        monkeypatch.setattr(store.Files, "move", stops)
        with pytest.raises(RuntimeError, match="lost"):
            batch.run(spark, changed)
        monkeypatch.setattr(store.Files, "move", moved)
        assert store.RunStore(spark, inputs["out"]).recover()
        now, _ = state(spark, inputs["out"])
        assert set(now) == set(first) and all(len(now[k]) > len(first[k]) for k in first)


def test_quality_control_in_a_run(spark, inputs, base):
    tmp_path = base[0]
    white = np.full((80, 160, 3), 250)
    white[:, :80] = np.random.default_rng(3).integers(0, 256, (80, 80, 3))
    (tmp_path / "a.png").write_bytes(png(white))
    every, _ = state(spark, inputs["out"])
    limits = {"white_share": 0.5, "black_share": None, "grey_share": None, "blur_least": None}
    assert batch.run(spark, {**inputs, "filtering": limits, "qc_spacing_um": 0.5, "resume": True}) == 0
    some, _ = state(spark, inputs["out"])
    assert some[("b", "tissue")] == every[("b", "tissue")]
    assert [t[1:] for t in some[("a", "tissue")]] == [t[1:] for t in every[("a", "tissue")] if t[1] < 80]


def test_attempted_gives_whole_results_or_an_error(spark):
    import pandas as pd

    def work(row):
        if row["k"] % 3 == 0:
            raise ZeroDivisionError(row["k"])
        return pd.DataFrame({"v": [row["k"]] * 2})

    good, bad = outcomes.attempted(spark.range(7).selectExpr("id k"), "k", work, "v bigint")
    assert sorted((r.k, r.v) for r in good.collect()) == sorted((k, k) for k in (1, 2, 4, 5) for _ in range(2))
    assert {r.k: r.error for r in bad.collect()} == {k: f"ZeroDivisionError: {k}" for k in (0, 3, 6)}
    assert all("Traceback" in r.trace for r in bad.collect())


def test_file_sets_are_whole_or_not_there(spark, tmp_path):
    rows = [(f"s{k}", [(".npz", bytes([k])), (".json", b"{}")]) for k in range(5)]
    kinds = "stem string, files array<struct<suffix:string,data:binary>>"
    out = str(tmp_path / "files")
    file_sets.write(spark.createDataFrame(rows, kinds), out)
    assert sorted(os.listdir(out)) == sorted(["_temporary", *(f"s{k}{x}" for k in range(5) for x in (".npz", ".json"))])
    assert os.listdir(f"{out}/_temporary") == []
    bad = spark.createDataFrame(rows, kinds).withColumn("stem", F.when(F.col("stem") == "s3", F.raise_error(F.lit("broken"))).otherwise(F.concat(F.lit("new-"), "stem")))
    with pytest.raises(Exception, match="broken"):
        file_sets.write(bad, out)
    assert not [f for f in os.listdir(out) if f.startswith("new-")] and os.listdir(f"{out}/_temporary") == []
    writer = file_sets.SetWriter(out)
    told = writer.write(iter([{"stem": "s1", "files": [{"suffix": ".npz", "data": b"other"}]}]))
    told.sets[0].append((f"{writer.job}/nowhere", f"{out}/s1.more"))
    with pytest.raises(OSError):
        writer.commit([told])
    assert open(f"{out}/s1.npz", "rb").read() == b"\x01"  # the half that had moved went back


def test_archives_and_previews_of_stored_results(spark, inputs, base):
    """Nothing is tiled again: the pairs of files and the stored tiles are enough."""
    own = store.RunStore(spark, inputs["out"])
    (base[0] / "b.png").unlink()
    saved = archives.save(own, part=10)
    told = {(r.sample_id, r.part): r for r in saved.collect()}
    n = own.tiles().where("slide_id = 'a'").count()
    assert sum(r.n_tiles for k, r in told.items() if k[0] == "a") == n > 10
    assert all("cannot open" in r.error for k, r in told.items() if k[0] == "b") and all(r.error is None for k, r in told.items() if k[0] != "b")
    assert all(0 < r.read_s + r.encode_s + r.write_s <= r.total_s for r in told.values() if r.error is None)
    image = decode_png((base[0] / "a.png").read_bytes())
    first = own.tiles().where("slide_id = 'a' and tile_index = 11").first()
    with tarfile.open(f"{inputs['out']}/tiles/a.tiles.0001.tar") as tar:
        assert tar.getnames()[0] == "000010.png"
        assert (decode_png(tar.extractfile("000011.png").read()) == image[first.y : first.y + 16, first.x : first.x + 16]).all()
    (summary,) = archives.timings(saved, 4).collect()
    assert summary.tiles == own.tiles().where("slide_id <> 'b'").count() and summary.mean_total_s > 0
    shown = {r.stem.split("/")[-1]: r for r in archives.previews(spark, f"{inputs['out']}/tiles", 80).collect()}
    assert "cannot open" in shown["b"].error and (shown["a"].width, shown["a"].height, shown["a"].n_tiles) == (80, 40, n)
    drawn = decode_png(bytes(shown["a"].image))
    at = own.tiles().where("slide_id = 'a' and tile_index = 0").first()
    assert (drawn[at.y // 2, at.x // 2 : at.x // 2 + 9] == 0).all() and (drawn[:3] != 0).any()
