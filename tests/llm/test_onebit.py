"""Searches by one-bit codes against all distances."""

import numpy as np
from gridquarry.llm import onebit
from pyspark.sql import functions as F

KINDS = "vec_id bigint, embedding array<float>, label int, row int, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3) for i, v in rows], KINDS)


def plain(rows, k=10):
    good = [(n, i, np.array(v, np.float32).astype(float)) for n, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for n, i, q in good:
        if i is None or i % 100:
            continue
        near = sorted((float(np.sqrt(np.add.reduce([(a - b) ** 2 for a, b in zip(x, q, strict=True)]))), j is None, j or 0, m) for m, j, x in good if m != n and len(x) == len(q))[:k]
        out += [(i, rank, None if none else j, round(d, 9)) for rank, (d, none, j, _) in enumerate(near, 1)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    got = onebit.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, **more)
    return sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()), key=str)


def test_equals_brute_force_in_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64)) + 2 * rng.normal(size=(5, 64))[rng.integers(0, 5, 3000)]
    x[500:520], x[700] = x[0], x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    monkeypatch.setattr(onebit, "QUERIES", 11)
    monkeypatch.setattr(onebit, "STEP", 100)
    assert found(spark, rows) == plain(rows)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(4000, 32)))]
    want = {(q, i) for q, _, i, _ in plain(rows)}
    got = {(q, i) for q, _, i, _ in found(spark, rows)}
    assert len(want & got) / len(want) >= 0.999


def test_odd_rows(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (100, [0, 1]), (None, [1, 1]), (5, [1, 1]), (6, None), (7, []), (8, [0, 0]), (9, [float("nan"), 1]), (10, [None, 1]), (11, [float("inf"), 1]), (200, [1, 2, 3]), (300, [1] * 7), (12, [2] * 7), (400, None)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, [1, 2]), (2, [3, 4])]) == []


def test_bounds_hold_and_codes_choose():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(5000, 64)), rng.normal(size=(40, 64))
    centre, turn = x.mean(axis=0), onebit.rotation(64, onebit.code_bits(64))
    least, most = onebit.bounds(*onebit.encode(x, centre, turn), q, centre, turn)
    exact = ((x[:, None, :] - q[None]) ** 2).sum(axis=2)
    assert ((least <= exact * 1.0001) & (exact <= most * 1.0001)).mean() > 0.99999
    limit = np.sort(exact, axis=0)[9]
    assert (least <= limit).mean() < 0.6  # the others are never reranked
    assert np.allclose(turn @ turn.T, np.eye(64))
