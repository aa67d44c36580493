"""Nearest neighbours from randomly rotated one-bit codes.

A vector less the centre of all vectors, of unit length, is rotated at random
into `bits` dimensions; the signs are its code, packed into bytes.  Beside them
stand its length and how well the code agrees with it, and with these two the
code gives an unbiased estimate of its inner product with any query, whose error
is bounded but for a probability that falls with the square of SURE: about 6e-7
for each pair at 5.  The k rows of a batch with the best estimates are measured first;
rows whose bound is beyond the k-th distance that a query has found so far, or than those
k, are passed over; the others are reranked by the distance of the original vectors in
double precision.

Every row is coded and met by every query: rows and queries are dealt to a grid,
so that a task has QUERIES queries at most, which it keeps, and a stream of rows,
which it does not.  A query gets its k best of each strip of rows, and the best
of those.  The work is queries times rows by definition; the rows that are sent
grow by one copy for every QUERIES queries.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
numbers take no part; vectors are compared with those of their length; a row that
is there twice is a neighbour of its double; a null id asks nothing and comes
after other ids at equal distance; fewer candidates than k give fewer rows; empty
tables have none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.llm import textkit as tk

#: Standard errors that the bound allows for.
SURE = 5.0
#: Queries that a task keeps.
QUERIES = 32_768
#: Rows are dealt to STRIPS strips, of LEAST_ROWS rows at least; beyond MOST_ROWS rows in each there are more.
STRIPS, LEAST_ROWS, MOST_ROWS = 16, 512, 1_000_000
#: Rows that are estimated together.
STEP = 4096


def rotation(dimensions: int, bits: int, seed: int = 1) -> np.ndarray:
    """A (dimensions, bits) matrix that keeps lengths: some rows of a random rotation."""
    made, r = np.linalg.qr(np.random.default_rng((seed, dimensions, bits)).normal(size=(bits, dimensions)))
    return (made * np.sign(np.diag(r))).T


def code_bits(dimensions: int, times: int = 8) -> int:
    return -(-dimensions * times // 64) * 64


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths from the centre, and the agreement of each vector's code with it (1 for a vector at the centre)."""
    away = x - centre
    length = np.linalg.norm(away, axis=1)
    turned = (away / np.where(length > 0, length, 1)[:, None]) @ turn
    agreement = np.where(length > 0, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1]), 1.0)
    return np.packbits(turned > 0, axis=1), length, agreement


def bounds(codes: np.ndarray, length: np.ndarray, agreement: np.ndarray, asked: np.ndarray, centre: np.ndarray, turn: np.ndarray, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries) each: what the squared distance is at least and at most, by the codes."""
    bits = turn.shape[1]
    away = asked - centre
    far = np.linalg.norm(away, axis=1)
    turned = ((away / np.where(far > 0, far, 1)[:, None]) @ turn).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32)
    # signs are 0 and 1: twice their product less the query's sum is that of -1 and 1
    inner = (2 * (signs @ turned.T) - turned.sum(axis=1)) / (np.sqrt(bits) * agreement).astype(np.float32)[:, None]
    error = (sure * np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement / np.sqrt(bits - 1)).astype(np.float32)[:, None]
    both, scale = (length[:, None] ** 2 + far[None, :] ** 2), 2 * length[:, None] * far[None, :]
    return both - scale * np.minimum(inner + error, 1.0), both - scale * np.maximum(inner - error, -1.0)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, summed from the first dimension to the last."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += (x[:, k] - q[:, k]) ** 2
    return np.sqrt(total)


def reached(estimates: np.ndarray, itself: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For each query a squared distance that k rows are within: the farthest of the k rows with the least estimates, measured exactly."""
    first = np.argpartition(np.where(itself, np.inf, estimates), k - 1, axis=0)[:k]
    far = distances(x[first.T.ravel()], np.repeat(queries, k, axis=0)).reshape(-1, k)
    return np.where(itself[first, np.arange(len(queries))].any(axis=0), np.inf, far.max(axis=1) ** 2)


class Best:
    """For each query the k nearest so far: distance, id (nulls last) and row number."""

    def __init__(self, n: int, k: int):
        self.far, self.none = np.full((n, k), np.inf), np.ones((n, k), bool)
        self.ids, self.rows = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def limit(self) -> np.ndarray:
        """Squared distances beyond which nothing is among the nearest."""
        return self.far[:, -1] ** 2

    def add(self, at: np.ndarray, far: np.ndarray, ids: np.ndarray, none: np.ndarray, rows: np.ndarray) -> None:
        """Candidates for queries `at`; those of one query stand together."""
        for q in np.unique(at).tolist():
            own = slice(*np.searchsorted(at, [q, q + 1]))
            every = [np.concatenate(pair) for pair in ((self.far[q], far[own]), (self.none[q], none[own]), (self.ids[q], ids[own]), (self.rows[q], rows[own]))]
            order = np.lexsort((every[3], every[2], every[1], every[0]))[: self.far.shape[1]]
            self.far[q], self.none[q], self.ids[q], self.rows[q] = (e[order] for e in every)


def _vectors(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)


def _packed(kind: str):
    """Vectors as bytes of the kind of the input; those that take no part have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed(batch)

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = pc.fill_null(batch.column("v"), pa.scalar([], batch.column("v").type))
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        bounds = column.offsets.to_numpy() - column.offsets[0].as_py()
        odd = np.append(0, np.cumsum(~np.isfinite(values)))
        full = np.append(0, np.cumsum(values != 0))
        good = (odd[bounds[1:]] == odd[bounds[:-1]]) & (full[bounds[1:]] > full[bounds[:-1]])
        data = [values[a:b].astype(kind).tobytes() if ok else None for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), good.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asks"), pa.array(bounds[1:] - bounds[:-1], pa.int32()), pa.array(data, pa.binary())], names=["id", "asks", "size", "data"])

    return run


def _sums(kind: str):
    """By length, how many vectors a batch has and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                x = _vectors(batch.column("data").take(pa.array(np.flatnonzero(sizes == size))), kind)
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.float64()))], names=["size", "n", "sums"])

    return run


def _coded(kind: str, centres: dict[int, np.ndarray], times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                turn = turns.setdefault(size, rotation(size, code_bits(size, times)))
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                codes, length, agreement = encode(_vectors(rows.column("data"), kind), centres.get(size, np.zeros(size)), turn)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(agreement)], names=[*rows.schema.names, "code", "length", "agreement"])

    return run


def _met(kind_of: str, centres: dict[int, np.ndarray], times: int, k: int, sure: float):
    """Cells of the grid: first the queries of a cell, then its rows; the k nearest of each query among them."""
    names = ["query_row", "query_id", "row", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, found = None, [], None
        queries = numbers = ids = None

        def told() -> Iterator[pa.RecordBatch]:
            if found is None:
                return
            at, place = np.nonzero(found.rows >= 0)
            told_ids = pa.array(found.ids[at, place], mask=found.none[at, place])
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), pa.array(ids[at]), pa.array(found.rows[at, place]), told_ids, pa.array(found.far[at, place])], names=names)

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("size", "strip", "share")]
            kind = batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in (*keys, kind)], axis=0)))[: batch.num_rows]
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                here = tuple(int(c[low]) for c in keys)
                rows = batch.slice(low, high - low)
                if here != cell:
                    yield from told()
                    cell, asked, found = here, [], None
                if kind[low] == 0:
                    asked.append(rows)
                    continue
                if not asked:
                    continue
                if found is None:
                    own = pa.Table.from_batches(asked)
                    queries = np.concatenate([_vectors(b.column("data"), kind_of) for b in asked])
                    numbers, ids = own["row"].to_numpy(), own["id"].to_numpy()
                    found, turn, centre = Best(len(queries), k), rotation(cell[0], code_bits(cell[0], times)), centres.get(cell[0], np.zeros(cell[0]))
                for start in range(0, rows.num_rows, STEP):
                    part = rows.slice(start, STEP)
                    x = _vectors(part.column("data"), kind_of)
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
                    length, agreement = part.column("length").to_numpy(), part.column("agreement").to_numpy()
                    own_rows = part.column("row").to_numpy()
                    own_none = pc.is_null(part.column("id")).to_numpy(zero_copy_only=False)
                    own_ids = pc.fill_null(part.column("id"), np.iinfo(np.int64).max).to_numpy()
                    for first in range(0, len(queries), 1024):
                        some = slice(first, first + 1024)
                        least, most = bounds(codes, length, agreement, queries[some], centre, turn, sure)
                        itself = own_rows[:, None] == numbers[some][None, :]
                        limit = found.limit()[some]
                        if len(x) > k:
                            limit = np.minimum(limit, reached(least + most, itself, x, queries[some], k))
                        near = ~itself & (least <= limit * (1 + 1e-5) + 1e-9)
                        at, which = np.nonzero(near.T)
                        for begin in range(0, len(at), 1 << 17):
                            q, r = at[begin : begin + (1 << 17)] + first, which[begin : begin + (1 << 17)]
                            found.add(q, distances(x[r], queries[q]), own_ids[r], own_none[r], own_rows[r])
        yield from told()

    return run


def nearest(vectors: DataFrame, asks: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", times: int = 8, sure: float = SURE) -> DataFrame:
    """For every row that `asks` holds for: query_id, rank from 1 on, vec_id and score, the Euclidean distance, of its k nearest among all other rows.

    times: bits of a code for each dimension.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    chosen = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v"))
    packed = chosen.mapInArrow(_packed(kind), "id bigint, asks boolean, size int, data binary").where("data is not null")
    rows = tk.stored(packed.withColumn("row", F.monotonically_increasing_id()), "vectors")
    centres = _centres(rows, kind)
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    strips, shares = max(1, -(-n // min(max(n // STRIPS, LEAST_ROWS), MOST_ROWS))), max(1, -(-n_asked // QUERIES))
    each = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    own = lambda most: F.pmod(F.hash("row"), F.lit(most))
    coded = rows.drop("asks").mapInArrow(_coded(kind, centres, times), "id bigint, size int, data binary, row bigint, code binary, length double, agreement double")
    searched = coded.withColumn("kind", F.lit(1)).withColumn("strip", own(strips)).withColumn("share", each(shares))
    asking = rows.where("asks").drop("asks").withColumn("kind", F.lit(0)).withColumn("share", own(shares)).withColumn("strip", each(strips))
    both = searched.unionByName(asking, allowMissingColumns=True)
    dealt = both.repartitionById(strips * shares, F.col("strip") * shares + F.col("share")).sortWithinPartitions("size", "strip", "share", "kind")
    met = dealt.mapInArrow(_met(kind, centres, times, k, sure), "query_row bigint, query_id bigint, row bigint, id bigint, score double")
    order = W.partitionBy("query_row").orderBy("score", F.col("id").asc_nulls_last(), "row")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _centres(rows: DataFrame, kind: str, most: int = 64) -> dict[int, np.ndarray]:
    """The mean vector for the `most` commonest lengths; others have the origin."""
    sums = rows.select("size", "data").mapInArrow(_sums(kind), "size int, n bigint, sums array<double>")
    common = sums.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "size").limit(most)
    added = sums.join(F.broadcast(common.select("size")), "size").select("size", "n", F.posexplode("sums").alias("p", "s")).groupBy("size", "p").agg((F.sum("s") / F.sum("n")).alias("c"))
    return {r["size"]: np.array([x["c"] for x in r["c"]]) for r in added.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("c")).collect()}
