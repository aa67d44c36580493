"""Grids of tiles are larger than the slides they come from, so that they must not go through the driver."""

import pytest

from gridquarry.plans import QUERIES

NAMES = [
    "tile_index",
    "supertile_dense_blocks",
    "supertile_index",
    "limit_tiles",
    "infer_stride",
    "artifact_roundtrip",
    "grid_preview",
    "group_plans",
    "preview_rects",
    "qc_batches",
    "region_slices",
    "tar_manifest",
    "tile_count_heuristic",
    "tile_coverage",
    "tile_index_contiguity",
    "coverage_summary",
    "preview_images",
    "supertile_greedy",
]


def nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from nodes(plan.children().apply(k))


def names(plan, down_to=("Join", "Aggregate", "Window")):
    """What a plan's rows go through since they were last joined, summed or numbered."""
    name = plan.nodeName()
    return [name, *(n for k in range(plan.children().size()) if not any(x in name for x in down_to) for n in names(plan.children().apply(k), down_to))]


@pytest.fixture
def whole_plans(spark, monkeypatch):
    """Plans with all that they come from: nothing is written in between."""
    from gridquarry import shared
    from gridquarry.operators import rendering, supertiles

    for module in (shared, rendering):
        monkeypatch.setattr(module, "stored", lambda df, label: df)
    monkeypatch.setattr(supertiles, "greedy", lambda tiles, step: tiles)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("query", NAMES)
def test_no_grid_is_broadcast(spark, whole_plans, query):
    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    found = list(nodes(plan))
    assert any(n.nodeName() == "Generate" for n in found)
    assert not [n for n in found if n.nodeName() == "BroadcastExchange" and "Generate" in names(n)]
