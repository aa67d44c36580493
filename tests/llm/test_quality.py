import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from gridquarry.llm import quality as ql
from gridquarry.llm.queries import op4_quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = ql.fit_network(x, y).probability(x)
    for low in (0.1, 0.4, 0.7):
        near = (p >= low) & (p < low + 0.2)
        assert abs(p[near].mean() - y[near].mean()) < 0.08


def test_odd_rows(spark):
    rows = [(k, f"Plain words {k} go on and on here" if k % 2 else "BAD!! WORDS!! HERE!! %%%", k % 2) for k in range(200)]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t, _ in rows] + [(900, None, 1.0, "x"), (901, "", 1.0, "x"), (None, "a b", 1.0, "x"), (902, "A b " * 60_000, 1.0, "x"), (902, "A b " * 60_000, 1.0, "x")], "doc_id bigint, text string, score double, x string")
    labels = spark.createDataFrame([(i, y, "t") for i, _, y in rows] + [(None, 1, "t"), (900, None, "t"), (7, 1, "t")], "doc_id bigint, quality int, text string")
    got = ql.quality(docs, labels).collect()
    assert len(got) == 205
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[900] == by_id[901]
    assert all((by_id[i] > 0.5) == bool(y) for i, _, y in rows)
    assert ql.quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in ql.quality(docs, labels.where(F.lit(False))).collect()} == {0.5}


def test_what_the_vectors_reach_alone(spark):
    """Held-out accuracy of the pooled vectors without the shares of shapes, repeats and length beside them."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality in (0, 1)").collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id in labels]
    x = ql._pooled(pa.array([t for _, t in rows], pa.string()), ql.word_vectors(docs.select("text")))
    y = np.array([labels[d] for d, _ in rows], float)
    apart = np.array([zlib.crc32(str(d).encode()) % 3 == 1 for d, _ in rows])
    right = {}
    for name, columns in (("vectors", slice(0, 2 * ql.DIMS)), ("all", slice(None))):
        p = ql.fit_network(x[~apart][:, columns], y[~apart]).probability(x[apart][:, columns])
        right[name] = ((p >= 0.5) == (y[apart] == 1)).mean()
    assert right["vectors"] > 0.95
    assert right["all"] >= right["vectors"]


def plain_row(text, vectors):
    """The features of a text by a loop over its words."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    total, squares, shapes, again = np.zeros(ql.DIMS), np.zeros(ql.DIMS), np.zeros(len(ql.SHAPES)), 0
    for k, w in enumerate(words):
        tail, shape = ql._tail(w), ql._shape(w)
        stem = w[: len(w) - len(tail)].lower() + b"\x00" + bytes([65 + shape]) + tail
        v = vectors[xxhash.xxh3_64_intdigest(stem) % ql.ROWS]
        total, squares = total + v, squares + v * v
        shapes[shape] += 1
        again += k > 0 and words[k - 1] == w
    n = max(1, len(words))
    mean = total / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean**2, 0)), shapes / n, [again / n, np.log1p(len(words)) / 10]])


def test_features_equal_plain_loops(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(150).collect()] + [None, "", "a"]
    vectors = np.random.default_rng(1).normal(size=(ql.ROWS, ql.DIMS))
    got = ql._pooled(pa.array(texts, pa.string()), vectors)
    assert np.allclose(got, [plain_row(t, vectors) for t in texts], atol=1e-6)
