"""Merkle manifests against trees built whole."""

import hashlib
import random

import pytest
from gridquarry.llm import merkle
from pyspark.sql import functions as F


def whole(leaves, fanout=8):
    """Siblings left and right on each level, and the root."""
    paths = [[] for _ in leaves]
    level, width = leaves, 1
    while len(level) > 1:
        for k, path in enumerate(paths):
            at = k // width
            low = at // fanout * fanout
            path.append(("".join(level[low:at]), "".join(level[at + 1 : low + fanout])))
        level = [merkle.digest(level[k : k + fanout]) for k in range(0, len(level), fanout)]
        width *= fanout
    return paths, level[0]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 513, 1000, 4095, 4096])
def test_traversal_equals_the_tree_built_whole(n):
    leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    paths, root = whole(leaves)
    assert list(merkle.traversal(leaves, merkle.height(n))) == paths
    stack = merkle.Treehash(merkle.height(n))
    for leaf in leaves:
        stack.push(leaf)
    assert stack.taken() == [root]


def test_stacks_stay_small():
    stack = merkle.Treehash(3)
    for k in range(512):
        stack.push(str(k))
        assert all(len(nodes) < merkle.FANOUT for nodes in stack.nodes[:-1])


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(rows):
    """By (group, id, text), the leaf, subroot, root and path of each row."""
    leaves = sorted(((g, i, hashlib.sha256((told(i) + told(g) + told(t)).encode()).hexdigest()) for i, g, t in rows), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    groups = {}
    for g, i, leaf in leaves:
        groups.setdefault(g, []).append((i, leaf))
    trees = {g: whole([leaf for _, leaf in own]) for g, own in groups.items()}
    tops, root = whole([trees[g][1] for g in groups])
    return sorted((str(i), leaf, trees[g][1], root, tuple(path + top)) for (g, own), top in zip(groups.items(), tops, strict=True) for (i, leaf), path in zip(own, trees[g][0], strict=True))


@pytest.mark.parametrize("n", [1, 40, 9000])
def test_manifest(spark, n):
    random.seed(n)
    rows = [(k if k % 50 else None, [None, "en", "de", "é", "z" * 40][k % 7 % 5] if k % 3 else "en", f"text é {k % 97}") for k in range(n)]
    rows += rows[:5]
    frame = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("key", F.lit("x")).withColumn("i", F.lit(1)).withColumn("digest", F.lit("y"))
    found = merkle.manifest(frame, ["doc_id", "lang", "text"], "lang", "doc_id", {"note": F.col("text")})
    got = [(str(r.doc_id), r.leaf, r.subroot, r.root, tuple((p.left, p.right) for p in r.path)) for r in found.collect()]
    assert sorted(got) == plain(rows)
    led = found.select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("f"), merkle.folded(F.lit("0" * 64), F.col("path")).alias("other"), merkle.proof(F.col("path")).alias("p"), "path").collect()
    assert all(r.f == r.root != r.other for r in led)
    assert all(r.p == "".join(p.left + p.right for p in r.path) for r in led)


def test_odd_rows(spark):
    kinds = "doc_id bigint, lang string, text string"
    manifest = lambda rows: merkle.manifest(spark.createDataFrame(rows, kinds), ["doc_id", "lang", "text"], "lang", "doc_id").collect()
    assert manifest([]) == []
    (r,) = manifest([(None, None, None)])
    assert r.leaf == r.subroot == r.root == hashlib.sha256(b"---").hexdigest()
    assert r.path == []
    same = [(1, "en", "a")] * 9 + [(2, "en", ""), (3, "en", "long " * 100_000)]
    got = manifest(same)
    assert len(got) == 11 and len({r.root for r in got}) == 1
