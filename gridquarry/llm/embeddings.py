"""Embedding near-duplicates by E8 lattice hashing.

A vector is projected to random directions, eight at a time, and each eight
coordinates are decoded to the nearest point of the E8 lattice; the points of
one table together name a cell.  A vector lives in its own cell of every table
and visits the PROBES lattice cells next nearest to it.  Whoever meets in a cell
with equal label is compared exactly, by cosine in double precision.

Cells shrink as rows grow: how many E8 points name a cell is fitted on a bounded
sample of the rows, so that a row is expected to meet about PARTNERS others
however many there are; and the number of tables follows from that, so that a
pair right at the threshold is met with the recall asked for (0.9999 unless the
caller says otherwise), which made pairs of unit vectors tell beforehand.

Equal vectors of a label collapse into one class before hashing.  A crowded cell
is compared in pairs of blocks, and every block gives sums and a spanning forest
only.  A pair that meets more than once counts at its first meeting, which both
vectors' cell names tell, so links are counted without listing pairs.

Defined cases: a null label, or a vector that is null, empty, zero or holds null
or non-finite numbers, links with nothing; vectors of different length do not
link; rows that are there twice link like other copies; a null id takes part,
but names a component only where all its ids are null, and is not kept; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm import graph
from gridquarry.llm import textkit as tk

#: Size of a cell, and cells visited besides a vector's own.
CELL, PROBES = 3.0, 4
#: Most E8 points that name a cell, 128 coordinates, and rows that a row is meant to meet.
DEEPEST, PARTNERS = 16, 256
#: Rows in a block of a crowded cell.
BLOCK = 1024
#: Crowded cells, of 16 bytes each, that are broadcast; more are joined by a shuffle.
MOST_CROWDED = 500_000


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, by their rule: two entries of one in size, or eight halves with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (1, -1):
                for t in (1, -1):
                    out.append([s if k == i else t if k == j else 0 for k in range(8)])
    for bits in range(256):
        signs = [1 - 2 * (bits >> k & 1) for k in range(8)]
        if signs.count(-1) % 2 == 0:
            out.append([s / 2 for s in signs])
    return np.array(out, float)


SHORTEST = _shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[rows]).argmax(axis=1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return near


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is the even points and their shift by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def cells(x: np.ndarray, label: np.ndarray, eights: int = 3, tables: int = 6, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Names of each unit vector's own cell in every table, (n, tables), and of the cells it visits, (n, tables, PROBES)."""
    n, d = x.shape
    own, visits = np.empty((n, tables), np.uint64), np.empty((n, tables, PROBES), np.uint64)
    for t in range(tables):
        places, points = _points(x, eights, t, seed)
        left = places - points
        gain = np.concatenate([left[:, 8 * e : 8 * e + 8] @ SHORTEST.T for e in range(eights)], axis=1)
        next_best = np.argsort(-gain, axis=1, kind="stable")[:, :PROBES]
        own[:, t] = _names(points, label, t)
        for p in range(PROBES):
            moved = points.copy()
            for e in range(eights):
                rows = np.flatnonzero(next_best[:, p] // 240 == e)
                moved[rows, 8 * e : 8 * e + 8] += SHORTEST[next_best[rows, p] % 240]
            visits[:, t, p] = _names(moved, label, t)
    return own, visits


def _points(x: np.ndarray, eights: int, t: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The projections of table t and their lattice points; those of fewer E8 points are the beginnings of those of more."""
    places = np.concatenate([x @ np.random.default_rng((seed, x.shape[1], t, e)).normal(size=(x.shape[1], 8)) for e in range(eights)], axis=1) / CELL
    return places, np.concatenate([e8_nearest(places[:, 8 * e : 8 * e + 8]) for e in range(eights)], axis=1)


def tables_for(eights: int, threshold: float, recall: float, dimensions: int, made: int = 1500) -> int:
    """Tables after which a pair of unit vectors right at the threshold has met with the recall asked for, told by made pairs."""
    rng = np.random.default_rng(dimensions)
    a, r = rng.normal(size=(2, made, max(2, dimensions)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * r / np.linalg.norm(r, axis=1, keepdims=True)
    label = np.zeros(made, np.int64)
    (x, v), (y, w) = cells(a, label, eights, 2), cells(b, label, eights, 2)
    met = (x == y) | (v == y[:, :, None]).any(axis=2) | (w == x[:, :, None]).any(axis=2)
    missed = min(max(1 - met.mean(), 1e-3), 0.99)
    return max(3, int(np.ceil(np.log(1 - recall) / np.log(missed))))


def _fitted(classes: DataFrame, kind: str, threshold: float, recall: float, sample: int = 20_000) -> tuple[int, int]:
    """E8 points for a cell's name and number of tables, from the `sample` classes with the smallest hash.

    Pairs that share a cell in the sample, scaled to all rows, tell how many others a row would
    meet; cells are named by as few points as keep that below PARTNERS, or by those that keep
    the work lowest.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data").to_pylist()
            sizes = np.array([len(d) for d in data])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                label = batch.column("label").to_numpy()[at]
                points = _points(_unit([data[k] for k in at.tolist()], kind), DEEPEST, 0)[1]
                for e in range(2, DEEPEST + 1):
                    names = _names(points[:, : 8 * e], label, 0)
                    yield pa.RecordBatch.from_arrays([pa.array([e] * len(at), pa.int32()), pa.array(names.view(np.int64))], names=["eights", "cell"])

    n, longest = classes.agg(F.count(F.lit(1)), F.max(F.length("data"))).first()
    if not n:
        return 2, 3
    some = classes.select("label", "data", "hi", "lo").orderBy(F.xxhash64("hi", "lo"), "hi", "lo").limit(sample).select("label", "data")
    met = some.mapInArrow(count, "eights int, cell bigint").groupBy("eights", "cell").agg(F.count(F.lit(1)).alias("c")).groupBy("eights").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
    pairs = {r["eights"]: r["pairs"] for r in met.collect()}
    seen, dimensions = min(n, sample), longest // np.dtype(kind).itemsize
    plans = []
    for eights in range(2, DEEPEST + 1):
        tables = tables_for(eights, threshold, recall, dimensions)
        others = pairs[eights] / seen * n / seen * (1 + PROBES)
        if others <= PARTNERS:
            return eights, tables
        plans.append((others * tables, eights, tables))
    return min(plans)[1:]


def _names(points: np.ndarray, label: np.ndarray, t: int) -> np.ndarray:
    name = tk.mixed(tk.mixed(label.astype(np.int64).view(np.uint64)) + np.uint64(t + 1))
    with np.errstate(over="ignore"):
        for column in (2 * points).astype(np.int64).view(np.uint64).T:
            name = tk.mixed(name * np.uint64(0x9E3779B97F4A7C15) + column)
    return name


def _named(kind: str):
    """Each vector's class digest (null if it can link with nothing) and its numbers as bytes of the kind of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield named(batch)

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("v")
        labels = batch.column("label").to_pylist()
        whole = pc.fill_null(column, pa.scalar([], column.type))
        values = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        bounds = (whole.offsets.to_numpy() - whole.offsets[0].as_py()) if len(whole) else np.zeros(1, int)
        rows = []
        for k, label in enumerate(labels):
            own = values[bounds[k] : bounds[k + 1]]
            norm = float(np.sqrt(own @ own)) if len(own) else 0.0
            if label is None or not 1e-100 < norm < 1e100 or not np.isfinite(own).all():
                scale = float(np.abs(own).max()) if len(own) else 0.0
                if label is None or not np.isfinite(scale) or scale == 0 or not np.isfinite(own).all():
                    rows.append((None, None, None))
                    continue
                own = own / scale  # squares may under- or overflow
            data = own.astype(kind).tobytes()
            digest = tk.digest16(f"{label}:".encode() + data)
            rows.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), data))
        hi, lo, data = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(data, pa.binary())], names=["vec_id", "label", "hi", "lo", "data"])

    return run


def _unit(data: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(len(data), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signed(kind: str, eights: int, tables: int):
    """Each class with the names of its cells: for each table its own and then those it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                yield from signed(batch.slice(low, 1000))

    def signed(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data = part.column("data").to_pylist()
        sizes = np.array([len(d) for d in data])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            rows = part.take(pa.array(at))
            own, visits = cells(_unit([data[k] for k in at.tolist()], kind), rows.column("label").to_numpy(), eights, tables)
            names = np.concatenate([own[:, :, None], visits], axis=2).reshape(len(at), -1).view(np.int64)
            listed = tk.listed(names.ravel(), np.full(len(at), names.shape[1]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("hi", "lo", "label", "copies", "data")), listed], names=["hi", "lo", "label", "copies", "data", "keys"])

    return run


def _compare(threshold: float, kind: str, tables: int):
    """Rows (hi, lo, links, hi2, lo2) from the rows of one cell, or of two blocks of it."""

    def judge(rows: dict[str, np.ndarray], across: bool) -> pa.RecordBatch:
        sizes = np.array([len(d) for d in rows["data"]])
        out = []
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if len(at) > 1:
                out += same_length({c: v[at] for c, v in rows.items()}, across)
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["hi", "lo", "links", "hi2", "lo2"])

    def same_length(rows: dict[str, np.ndarray], across: bool) -> list[tuple]:
        x = _unit(rows["data"].tolist(), kind)
        home, t0 = rows["visit"] < 0, int(rows["t"][0])
        linked = x @ x.T >= threshold
        linked &= (home[:, None] | home[None, :]) & (rows["label"][:, None] == rows["label"][None, :]) & (rows["t"][:, None] == rows["t"][None, :])
        np.fill_diagonal(linked, False)
        if across:
            linked &= rows["block"][:, None] != rows["block"][None, :]
        a, b = np.nonzero(np.triu(linked))
        if not len(a):
            return []
        # from here on, a is the smaller of the two by name
        swap = (rows["hi"][a] > rows["hi"][b]) | ((rows["hi"][a] == rows["hi"][b]) & (rows["lo"][a] > rows["lo"][b]))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        keys = np.stack(rows["keys"]).reshape(len(x), tables, 1 + PROBES)
        own, visits = keys[:, :, 0], keys[:, :, 1:]
        met = np.zeros(len(a), bool)
        for t in range(t0):
            met |= own[a, t] == own[b, t]
            met |= (visits[b, t] == own[a, t][:, None]).any(axis=1) | (visits[a, t] == own[b, t][:, None]).any(axis=1)
        met |= ~home[a] & (visits[b, t0] == own[a, t0][:, None]).any(axis=1)
        a, b = a[~met], b[~met]
        links = np.bincount(a, rows["copies"][b], len(x)) + np.bincount(b, rows["copies"][a], len(x))
        root = graph.forest(linked)
        told = np.flatnonzero((links > 0) | (root != np.arange(len(x))))
        return [(int(rows["hi"][k]), int(rows["lo"][k]), int(links[k]), int(rows["hi"][root[k]]), int(rows["lo"][root[k]])) for k in told.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, homes = None, [], False

        def flush() -> Iterator[pa.RecordBatch]:
            if homes and sum(h.num_rows for h in held) > 1:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield judge({c: whole[c].to_numpy(zero_copy_only=False) for c in whole.column_names}, key[1] != key[2])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("cell", "left", "right")]
            cut = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))[: batch.num_rows]
            if not len(cut):
                continue
            # cells that are only visited have nothing to compare
            lives = np.add.reduceat(batch.column("visit").to_numpy() < 0, cut) > 0
            for low, high, home in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows], lives.tolist(), strict=True):
                own = tuple(int(c[low]) for c in columns)
                if own != key:
                    yield from flush()
                    key, held, homes = own, [], False
                held.append(batch.slice(low, high - low))
                homes |= home
        yield from flush()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", recall: float = 0.9999) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id (smallest id reachable by links) and kept (whether that is its own)."""
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    chosen = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    named = tk.stored(chosen.mapInArrow(_named(kind), "vec_id bigint, label bigint, hi bigint, lo bigint, data binary"), "vectors")
    classes = named.where("hi is not null").groupBy("hi", "lo").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("data").alias("data"))
    classes = tk.stored(classes, "classes")
    eights, tables = _fitted(classes, kind, threshold, recall)
    signed = tk.stored(classes.drop("rep").mapInArrow(_signed(kind, eights, tables), "hi bigint, lo bigint, label bigint, copies bigint, data binary, keys array<bigint>"), "signed")
    crowded = tk.stored(signed.select(F.explode("keys").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "crowded")
    few = crowded.count() <= MOST_CROWDED
    rows = signed.select("*", F.posexplode("keys").alias("_p", "cell")).withColumn("t", F.floor(F.col("_p") / (1 + PROBES)).cast("int")).withColumn("visit", (F.col("_p") % (1 + PROBES) - 1).cast("int")).drop("_p")
    sized = rows.join(F.broadcast(crowded) if few else crowded, "cell", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = graph.in_blocks(sized, BLOCK, F.col("lo"))
    keys = ["cell", "left", "right"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys)
    compared = tk.stored(ordered.mapInArrow(_compare(threshold, kind, tables), "hi bigint, lo bigint, links bigint, hi2 bigint, lo2 bigint"), "compared")
    links = compared.groupBy("hi", "lo").agg(F.sum("links").alias("links"))
    roots = graph.components(compared.select(F.struct("hi", "lo").alias("a"), F.struct(F.col("hi2").alias("hi"), F.col("lo2").alias("lo")).alias("b"))).select("node.hi", "node.lo", "root")
    grouped = classes.select("hi", "lo", "rep", "copies").join(roots, ["hi", "lo"], "left").withColumn("root", F.coalesce("root", F.struct("hi", "lo")))
    told = grouped.join(grouped.groupBy("root").agg(F.min("rep").alias("component_id")), "root").join(links, ["hi", "lo"], "left")
    told = tk.stored(told.select("hi", "lo", "component_id", (F.col("copies") + F.coalesce("links", F.lit(0)) - 1).alias("n_links")), "classes")
    out = named.select("vec_id", "hi", "lo").join(told, ["hi", "lo"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
