"""Document quality: random-indexing word vectors, pooled, into a two-layer network with calibrated probabilities.

Every token has a fixed sparse random index vector.  A word's vector is the sum
of the index vectors of its neighbours over the whole corpus, added up in the
tasks and then by Spark, so it grows with the input while its size stays fixed:
words share ROWS hashed rows.  A document's vector pools the vectors of its
tokens (mean and spread) with a few shares of token shapes.  A two-layer numpy
network is fitted on a bounded sample of labelled rows, and one temperature,
chosen on a part of the sample kept apart, makes its outputs probabilities.

Defined cases: null text is scored like empty text, whose pooled vector is zero;
without labelled rows of both kinds every score is 0.5; repeated rows get equal
scores; of different labels of one id the larger counts.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm import textkit as tk

#: Hashed word rows, dimensions, nonzeros of an index vector, neighbours on each side.
ROWS, DIMS, NONZERO, REACH = 8192, 32, 4, 2
SHAPES = ("lower", "Title", "UPPER", "digit", "other", "mixed")
#: Fixed random index vectors: the places and signs of their nonzeros, by row.
_PLACES = (tk.mixed(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(1)) % np.uint64(DIMS)).astype(np.int64).reshape(ROWS, NONZERO)
_SIGNS = ((tk.mixed(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(1 << 32)) & np.uint64(1)).astype(np.float64) * 2 - 1).reshape(ROWS, NONZERO)


def _shape(word: bytes) -> int:
    """The place in SHAPES of a token: letters by case, digits, neither, or letters and others."""
    text = word.decode("utf-8", "replace")
    core = text.strip(".,;:!?\"'()")
    if core.isdigit():
        return 3
    if core.isalpha():
        return 0 if core.islower() else 2 if core.isupper() and len(core) > 1 else 1
    return 5 if any(c.isalpha() for c in core) else 4


def _tail(word: bytes) -> bytes:
    """What stands behind the last letter or digit: "", "," or "!!"."""
    text = word.decode("utf-8", "replace")
    k = len(text)
    while k and not text[k - 1].isalnum():
        k -= 1
    return text[k:].encode()


class Tokens:
    """Rows of a slice's tokens.  A token's row is that of its word; words with unusual endings or shapes also stand for those."""

    def __init__(self, column: pa.Array):
        found = tk.words(column, tk.WHITE)
        self.bounds = found.bounds
        shapes = np.array([_shape(w) for w in found.vocabulary], np.int64)
        tails = [_tail(w) for w in found.vocabulary]
        stems = [w[: len(w) - len(t)].lower() + b"\x00" + bytes([65 + s]) + t for w, t, s in zip(found.vocabulary, tails, shapes.tolist(), strict=True)]
        rows = (tk.word_hashes(stems) % np.uint64(ROWS)).astype(np.int64)
        marks = (tk.word_hashes([b"\x01" + bytes([65 + s]) + t for t, s in zip(tails, shapes.tolist(), strict=True)]) % np.uint64(ROWS)).astype(np.int64)
        self.rows, self.marks, self.shapes = rows[found.codes], marks[found.codes], shapes[found.codes]
        self.same = np.append(False, found.codes[1:] == found.codes[:-1])[: len(found.codes)]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x DIMS sums over all documents, each vector then brought to length 1; of fixed size whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIMS)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                tokens = Tokens(part.column("text"))
                doc = np.repeat(np.arange(len(tokens.bounds) - 1), np.diff(tokens.bounds))
                for step in range(1, REACH + 1):
                    near = doc[step:] == doc[:-step]
                    left, right = tokens.rows[:-step][near], tokens.rows[step:][near]
                    for a, b in ((left, tokens.marks[step:][near]), (right, tokens.marks[:-step][near]), (left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(a * DIMS + _PLACES[b, k], weights=_SIGNS[b, k], minlength=ROWS * DIMS)
                for k in range(NONZERO):
                    total += np.bincount(tokens.rows * DIMS + _PLACES[tokens.marks, k], weights=_SIGNS[tokens.marks, k], minlength=ROWS * DIMS)
        sums = total.reshape(ROWS, DIMS).astype(np.int64)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["row", "v"])

    summed = docs.mapInArrow(run, "row bigint, v array<bigint>").groupBy("row").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(DIMS)]).alias("v"))
    got = summed.toArrow()
    vectors = np.zeros((ROWS, DIMS))
    if got.num_rows:
        vectors[got["row"].to_numpy()] = np.array(got["v"].to_pylist(), float)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def _pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the tokens' vectors, shares of shapes and of immediate repeats, and the logarithm of the length, by document."""
    tokens = Tokens(column)
    n = len(column)
    sizes = np.diff(tokens.bounds)
    doc = np.repeat(np.arange(n), sizes)
    of = np.maximum(sizes, 1)[:, None]
    out = [np.zeros((n, DIMS)) for _ in range(2)]
    for k in range(DIMS):
        own = vectors[tokens.rows, k]
        out[0][:, k] = np.bincount(doc, own, n)
        out[1][:, k] = np.bincount(doc, own * own, n)
    mean = out[0] / of
    spread = np.sqrt(np.maximum(out[1] / of - mean**2, 0))
    shares = np.bincount(doc * len(SHAPES) + tokens.shapes, minlength=n * len(SHAPES)).reshape(n, -1) / of
    again = np.bincount(doc, tokens.same, n)[:, None] / of
    return np.concatenate([mean, spread, shares, again, np.log1p(sizes)[:, None] / 10], axis=1)


@dataclass(frozen=True)
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 60, seed: int = 7) -> Network:
    """Adam on log loss with weight decay; a fifth of the rows is kept apart for the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    apart, train = order[: len(y) // 5], order[len(y) // 5 :]
    centre, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    z = (x - centre) / scale
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            h = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - h**2)
            step += 1
            for k, g in enumerate((z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ error + 1e-4 * params[2], error.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    raw = Network(centre, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    own = apart if len(apart) else train
    logits, best = raw.logits(x[own]), (np.inf, 1.0)
    for t in np.geomspace(0.25, 8, 41):
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -30, 30))), 1e-9, 1 - 1e-9)
        best = min(best, (float(-(y[own] * np.log(p) + (1 - y[own]) * np.log(1 - p)).mean()), float(t)))
    return Network(centre, scale, *params[:3], float(params[3][0]), best[1])


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out and score: the probability that the label is 1.

    Labels are learnt only from rows whose id is not held out, at most max_rows of them (those
    with the smallest hash of their id).
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    vectors = word_vectors(docs.select("text"))
    sample = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~tk.held_out(F.col(id_col)))
    sample = sample.groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                pooled = _pooled(part.column("text"), vectors)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(pooled), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    chosen = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    got = chosen.mapInArrow(pool, "doc_id bigint, y int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toArrow()
    y = got["y"].to_numpy().astype(float)
    network = fit_network(np.array(got["x"].to_pylist()), y) if len(y) > 9 and y.min() < y.max() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                pooled = _pooled(part.column("text"), vectors)
                score = network.probability(pooled) if network else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id bigint, score double").withColumn("held_out", tk.held_out(F.col("doc_id")))
