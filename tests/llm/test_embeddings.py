import math

import numpy as np
import pytest
from gridquarry.llm import embeddings as em
from gridquarry.llm.queries import op9_embedding_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.98):
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    def usable(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    for a in range(n):
        for b in range(a + 1, n):
            (_, v, x), (_, w, y) = rows[a], rows[b]
            if x == y and usable(v, x) and usable(w, y) and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                v, w = v / np.abs(v).max(), w / np.abs(w).max()
                if v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    out = []
    for k in range(n):
        low = min(rows[j][0] for j in range(n) if root(j) == root(k))
        out.append((rows[k][0], links[k], low, rows[k][0] == low))
    return sorted(out)


def clusters(rng, n, spread):
    """Groups around centres, with noise that puts many cosines near the threshold."""
    rows = []
    for k in range(n):
        v = np.random.default_rng(k // 5).normal(size=64)
        rows.append((k, (v + spread * rng.normal(size=64)).astype(np.float32).tolist(), k % 2))
    return rows


@pytest.mark.parametrize(("block", "spread"), [(1024, 0.08), (4, 0.05)])
def test_equals_brute_force(spark, monkeypatch, block, spread):
    monkeypatch.setattr(em, "BLOCK", block)
    rows = clusters(np.random.default_rng(1), 200, spread)
    rows += [(300 + k, rows[0][1], 0) for k in range(20)] + [(330 + k, [x * (k + 1) for x in rows[1][1]], 1) for k in range(6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted(tuple(r) for r in em.near_duplicates(frame).collect())
    assert got == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=(4000, 64))
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    label = np.zeros(4000, np.int64)
    (x, v), (y, w) = em.cells(a, label), em.cells(b, label)
    met = (x == y) | (v == y[:, :, None]).any(axis=2) | (w == x[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() > 0.99


def test_nearest_point_is_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * 2
    near = em.e8_nearest(x)
    own = ((x - near) ** 2).sum(axis=1)
    for v in em.SHORTEST:
        assert (own <= ((x - near - v) ** 2).sum(axis=1) + 1e-9).all()


def test_query_and_odd_rows(spark):
    got = op9_embedding_dedup(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, float("nan")], 0), (6, [1.0, float("inf")], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (8, [1.0, 2.0], 0), (9, [1e-30, 2e-30], 0), (10, [1.0, 2.0, 0.0], 0), (11, [1.0, 2.0], 1)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<double>, label int, copies int")
    assert sorted(tuple(r) for r in em.near_duplicates(frame).collect()) == brute(rows)
    assert em.near_duplicates(frame.limit(0)).count() == 0
