"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

Documents are sets of word shingles.  Equal sets collapse into one class first,
by a digest of the whole set.  Each class gets a MinHash signature, cut into
trees of PATH values; the signatures of a tree, sorted whole, are its prefix
trie.  Classes that stand under one prefix in some tree are candidates.  The
walk starts at whole paths and shortens the prefix step by step, down to the
length at which not even pairs right at the threshold are missed more often than
1 - recall.  It ends before only if all candidate pairs, none left out, prove
that no two classes that meet are that far apart.

Candidates gather in components.  Inside a component classes are compared
exactly, on their whole shingle sets, in pairs of blocks.  A wide component
whose prefix runs are narrow (many texts that are alike only in chains) is
compared run by run instead, which costs less; a pair that shares several runs
counts in the first.

So links are counted without being written out: a group of copies collapses to
one class, and a large group of near copies is compared block by block, each
block pair giving only sums and a spanning forest.

Words are runs of anything but ASCII white space, with A-Z folded to a-z.
Defined cases: null text is like empty text, and documents without words are
one class; with fewer words than a shingle, the words together are the only
shingle; rows that are there twice, id and all, link like other copies; a null
id takes part but never names a class unless all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm import graph
from gridquarry.llm import textkit as tk

FOLDED = tk._table(bytes([0x20, *range(0x09, 0x0E)]), lower=True)
#: Trees and the longest path in each.
TREES, PATH = 32, 8
#: Classes in a block of the exact comparison.
BLOCK = 256
_FACTORS = (tk.mixed(np.arange(1, TREES * PATH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

SIGNED = "doc_id bigint, h bigint, hi bigint, lo bigint, size int, signature binary"


def depth_for(threshold: float, recall: float, trees: int = TREES, longest: int = PATH) -> int:
    """Shorten the matched prefix from its full length until a pair at the threshold is found with the recall asked for."""
    for depth in range(longest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and each document's bounds in them."""
    found = tk.words(column, FOLDED)
    sizes = np.diff(found.bounds)
    hashes = tk.word_hashes(found.vocabulary)[found.codes] if len(found.codes) else np.zeros(0, np.uint64)
    runs = tk.run_hashes(hashes, width)
    doc = np.repeat(np.arange(len(column)), sizes)
    inside = np.flatnonzero(doc[: len(runs)] == doc[width - 1 : width - 1 + len(runs)]) if len(runs) else np.zeros(0, np.int64)
    values, owner = runs[inside], doc[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        whole = [tk.mixed(np.array([tk.run_hashes(hashes[found.bounds[d] : found.bounds[d + 1]], int(sizes[d]))[0] + np.uint64(sizes[d])], np.uint64))[0] for d in short.tolist()]
        values, owner = np.append(values, np.array(whole, np.uint64)), np.append(owner, short)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.append(True, (np.diff(owner) != 0) | (values[1:] != values[:-1]))[: len(values)]
    values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(len(column) + 1))


def _signatures(width: int):
    """Each document's class digest, number of shingles and MinHash signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                values, bounds = _shingles(part.column("text"), width)
                data = values.tobytes()
                names = np.frombuffer(b"".join([tk.digest16(data[8 * x : 8 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]), "<i8").reshape(-1, 2)
                some = np.flatnonzero(np.diff(bounds))
                least = np.full((part.num_rows, TREES * PATH), np.uint32(2**32 - 1))
                low = (values >> np.uint64(32)).astype(np.uint32)
                for k in range(TREES * PATH) if len(some) else ():
                    least[some, k] = np.minimum.reduceat(low * _FACTORS[k], bounds[:-1][some])
                signature = least.astype(">u4").tobytes()
                step = 4 * TREES * PATH
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(np.diff(bounds), pa.int32()), pa.array([signature[k * step : (k + 1) * step] for k in range(part.num_rows)], pa.binary())],
                    names=["doc_id", "h", "hi", "lo", "size", "signature"],
                )

    return run


def _adjacent(least: int):
    """For each row and prefix length from the whole path down to `least`, the first row of its run in the sorted trie; and, with their prefixes, the first rows of each partition's outer runs.

    A row is told once for all lengths that lead to the same first row, with the longest of them.
    """
    lengths = range(PATH, least - 1, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer: dict[int, list[tuple[bytes, int, int]]] = {d: [] for d in lengths}
        last: np.ndarray | None = None
        head = {d: (0, 0) for d in lengths}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.empty((n, 4 + 4 * PATH), np.uint8)
            keys[:, :4] = batch.column("tree").to_numpy().astype(">i4")[:, None].view(np.uint8)
            keys[:, 4:] = tk.flat(batch.column("path"))[0].reshape(n, 4 * PATH)
            hi, lo = batch.column("hi").to_numpy(), batch.column("lo").to_numpy()
            before = keys[:1] ^ np.uint8(255) if last is None else last
            differ = np.concatenate([before, keys[:-1]]) != keys
            known = (np.full(n, 0, np.int64), np.full(n, 0, np.int64), np.zeros(n, bool))
            for d in lengths:
                new = differ[:, : 4 + 4 * d].any(axis=1)
                at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                to_hi, to_lo = np.where(at < 0, head[d][0], hi[at]), np.where(at < 0, head[d][1], lo[at])
                head[d] = (int(to_hi[-1]), int(to_lo[-1]))
                outer[d] = outer[d] or [(keys[0, : 4 + 4 * d].tobytes(), int(hi[0]), int(lo[0]))]
                outer[d][1:] = [(keys[-1, : 4 + 4 * d].tobytes(), *head[d])]
                own = ~new & ~(known[2] & (known[0] == to_hi) & (known[1] == to_lo))
                known = (np.where(new, known[0], to_hi), np.where(new, known[1], to_lo), known[2] | ~new)
                yield _edge_rows(hi[own], lo[own], to_hi[own], to_lo[own], d)
            last = keys[-1:].copy()
        for d, rows in outer.items():
            for key, h, w in rows:
                yield _edge_rows(np.array([h]), np.array([w]), np.array([0]), np.array([0]), d, key)

    return run


def _edge_rows(hi: np.ndarray, lo: np.ndarray, hi2: np.ndarray, lo2: np.ndarray, depth: int, prefix: bytes | None = None) -> pa.RecordBatch:
    columns = [*(pa.array(x, pa.int64()) for x in (hi, lo, hi2, lo2)), pa.array([depth] * len(hi), pa.int32()), pa.array([prefix] * len(hi), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "hi2", "lo2", "depth", "prefix"])


def _node(hi: str, lo: str):
    return F.struct(F.col(hi).alias("hi"), F.col(lo).alias("lo"))


def candidate_edges(classes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """classes: (hi, lo, signature).  Edges (a, b) that join all classes with a common prefix in some tree, and the prefix length at which the walk ended.

    The tries are range-partitioned by tree, path and class, so a prefix that very many classes
    share is spread over many partitions; the first rows of the runs at their edges join the parts again.
    A class has at most a few first rows in each tree; they are tied to the smallest of them, so
    that runs of different trees with the same members leave few edges.
    """
    least = depth_for(threshold, recall)
    paths = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("signature", t * 4 * PATH + 1, F.lit(4 * PATH)).alias("path")))
    tries = classes.select("hi", "lo", F.explode(paths).alias("_p")).select("_p.tree", "_p.path", "hi", "lo")
    ordered = tries.repartitionByRange("tree", "path", "hi", "lo").sortWithinPartitions("tree", "path", "hi", "lo")
    found = tk.stored(ordered.mapInArrow(_adjacent(least), "hi bigint, lo bigint, hi2 bigint, lo2 bigint, depth int, prefix binary"), "tries")
    inner = found.where("prefix is null").select(_node("hi", "lo").alias("a"), _node("hi2", "lo2").alias("b"), "depth")
    outer = found.where("prefix is not null").select("prefix", _node("hi", "lo").alias("a"), "depth")
    across = outer.join(outer.groupBy("prefix").agg(F.min("a").alias("b")), "prefix").where("a <> b").select("a", "b", "depth")
    depth = _walked(inner, across, classes, threshold, recall, least)
    joined = inner.where(F.col("depth") >= depth).union(across.where(F.col("depth") == depth))
    heads = joined.where("a <> b").groupBy("a").agg(F.collect_set("b").alias("heads")).withColumn("b", F.array_min("heads"))
    edges = tk.stored(heads.select(F.explode(F.concat(F.array("a"), "heads")).alias("a"), "b").where("a <> b").distinct(), "candidates")
    tk.unstored(found)
    return edges, depth


def _walked(inner: DataFrame, across: DataFrame, classes: DataFrame, threshold: float, recall: float, least: int) -> int:
    """The longest prefix, from `least` up, that meets any two classes of one run with the recall asked for.

    Pairs (a, b, depth) of a class and the first of its run count whether they stand in one partition
    (inner) or not (across), so it does not matter where partitions begin.  A pair that meets at no
    longer prefix ends the walk there.  Otherwise the farthest pair bounds how far apart any two classes
    of a run can be: by the triangle inequality, their signatures differ in twice as many values at most,
    or four times as many if partitions part runs (class, first in its partition, first of all, and back).
    """
    told = inner.withColumn("parted", F.lit(False)).union(across.withColumn("parted", F.lit(True)))
    pairs = told.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("depth").alias("depth"), F.max("parted").alias("parted"))
    longest, parted = pairs.agg(F.min("depth"), F.max("parted")).first()
    if longest is None or longest == least:
        return least
    signed = classes.select(_node("hi", "lo").alias("a"), "signature")
    both = pairs.join(signed, "a").join(signed.toDF("b", "other"), "b").select("signature", "other")
    equal = both.mapInArrow(_equal_values, "equal bigint").agg(F.min("equal")).first()[0]
    return min(longest, depth_for(max(threshold, surely_alike(1 - (4 if parted else 2) * (1 - equal / (TREES * PATH)))), recall))


def _equal_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of signatures, the number of values in which they agree."""
    for batch in batches:
        one, other = (tk.flat(x)[0].view(np.uint32).reshape(batch.num_rows, TREES * PATH) for x in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array((one == other).sum(axis=1).astype(np.int64))], names=["equal"])


def surely_alike(share: float, n: int = TREES * PATH, z: float = 4) -> float:
    """The similarity that texts have at least whose signatures agree in this share of values: Wilson's lower bound at four standard deviations."""
    share = max(share, 0.0)
    return (share + z**2 / (2 * n) - z * (share * (1 - share) / n + (z / (2 * n)) ** 2) ** 0.5) / (1 + z**2 / n)


def _verify(width: int, threshold: float):
    """Exact comparison of the block pairs, which come sorted: link sums by class, and a spanning forest."""
    unit = ("root_hi", "root_lo", "run", "left", "right")

    def judge(rows: list[dict]) -> pa.RecordBatch:
        side = np.array([r["block"] for r in rows])
        values, bounds = _shingles(pa.array([r["text"] for r in rows], pa.string()), width)
        sizes = np.diff(bounds)
        rep = np.array([r["copies"] for r in rows], np.int64)
        linked = _linked(values, bounds, sizes, threshold)
        np.fill_diagonal(linked, False)
        if rows[0]["left"] != rows[0]["right"]:  # rows of one block meet in a pair of their own
            linked &= side[:, None] != side[None, :]
        for t in range(rows[0]["tree"]):  # a pair counts in the first tree where it meets
            own = np.array([r["prefixes"][t] for r in rows])
            linked &= own[:, None] != own[None, :]
        links, root = linked @ rep, graph.forest(linked)
        return pa.RecordBatch.from_arrays(
            [pa.array([r["hi"] for r in rows], pa.int64()), pa.array([r["lo"] for r in rows], pa.int64()), pa.array(links), pa.array([rows[k]["hi"] for k in root.tolist()], pa.int64()), pa.array([rows[k]["lo"] for k in root.tolist()], pa.int64())],
            names=["hi", "lo", "links", "hi2", "lo2"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[c] for c in unit)
                if own == key and (row["hi"], row["lo"], row["block"]) == (rows[-1]["hi"], rows[-1]["lo"], rows[-1]["block"]):
                    continue
                if own != key:
                    if len(rows) > 1:
                        yield judge(rows)
                    key, rows = own, []
                rows.append(row)
        if len(rows) > 1:
            yield judge(rows)

    return run


def _linked(values: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows have a Jaccard similarity of at least the threshold, by counting common shingles of all pairs with matrix products."""
    n = len(sizes)
    if n == 2:
        both = len(np.intersect1d(values[bounds[0] : bounds[1]], values[bounds[1] : bounds[2]], assume_unique=True))
        out = np.zeros((2, 2), bool)
        out[0, 1] = out[1, 0] = both >= threshold * (sizes.sum() - both) - 1e-9
        return out
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    ordered, owner = values[order], owner[order]
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(start, len(ordered)))
    column = np.repeat(np.cumsum(count > 1) - 1, count)
    shared = np.repeat(count > 1, count)
    column, owner = column[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, (low, low + 4096))
        bits = np.zeros((n, min(4096, int(column[-1]) + 1 - low)), np.float32)
        bits[owner[x:y], column[x:y] - low] = 1
        common += bits @ bits.T
    union = sizes[:, None] + sizes[None, :] - common
    return common.astype(float) >= threshold * union.astype(float) - 1e-9


def jaccard_join(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id (smallest id reachable by links), n_links (documents linked directly, copies included), n_copies (documents with the same shingles, itself included)."""
    signed, told = _classified(docs, width, threshold, recall, id_col, text_col)
    return signed.select("doc_id", "hi", "lo").join(told, ["hi", "lo"]).select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links", "n_copies")


def one_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of linked documents one row of docs, with all columns: that with the smallest id."""
    _, told = _classified(docs, width, threshold, recall, id_col, text_col)
    k, h = tk.free("_k", docs.columns), tk.free("_h", docs.columns)
    first = told.select(F.coalesce("first.doc_id", F.lit(-1)).alias(k), F.col("first.h").alias(h)).distinct()
    keyed = docs.withColumn(k, F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1))).withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(first, [k, h], "left_semi").dropDuplicates([k, h]).select(docs.columns)


def _classified(docs: DataFrame, width: int, threshold: float, recall: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hi, lo) of each document; and by class (hi, lo) its links, copies and the first document of its group."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    signed = tk.stored(docs.mapInArrow(_signatures(width), SIGNED), "signatures")
    lowest = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))).alias("_r")
    classes = signed.groupBy("hi", "lo").agg(lowest, F.count(F.lit(1)).alias("copies"), F.min("signature").alias("signature"), F.min("size").alias("size"))
    classes = tk.stored(classes.select("hi", "lo", F.col("_r.doc_id").alias("rep"), F.col("_r.h").alias("h"), "copies", "signature", "size"), "classes")
    edges, depth = candidate_edges(classes.where("size > 0").select("hi", "lo", "signature"), threshold, recall)
    near = graph.components(edges).select("node.hi", "node.lo", F.col("root.hi").alias("root_hi"), F.col("root.lo").alias("root_lo"))
    members = tk.stored(near.join(classes, ["hi", "lo"]), "members")
    compared = _compared(docs, members, depth, width, threshold)
    tk.unstored(members)
    links = compared.groupBy("hi", "lo").agg(F.sum("links").alias("links"))
    roots = graph.components(compared.select(_node("hi", "lo").alias("a"), _node("hi2", "lo2").alias("b"))).select("node.hi", "node.lo", "root")
    grouped = classes.select("hi", "lo", F.struct(F.col("rep").isNull().alias("no_id"), F.col("rep").alias("doc_id"), "h").alias("own"), "copies")
    grouped = grouped.join(roots, ["hi", "lo"], "left").withColumn("root", F.coalesce("root", _node("hi", "lo")))
    told = grouped.join(grouped.groupBy("root").agg(F.min("own").alias("first")), "root").join(links, ["hi", "lo"], "left")
    told = told.select("hi", "lo", "first", (F.col("copies") + F.coalesce("links", F.lit(0)) - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return signed, tk.stored(told, "classes")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose (k, h) has not been there in this task, so that rows repeated very often shrink before the shuffle."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = []
        for key in zip(batch.column("k").to_pylist(), batch.column("h").to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep))


def _compared(docs: DataFrame, members: DataFrame, depth: int, width: int, threshold: float) -> DataFrame:
    """Exact comparison inside candidate components: rows (hi, lo, links, hi2, lo2), several for a class; links add up, and (hi2, lo2) is linked to it by a path."""
    group = ["root_hi", "root_lo"]
    #: A block has BLOCK classes or as many shingles as 4096 for each of them; n counts the fuller way.
    full = lambda: F.greatest(F.count(F.lit(1)), F.sum("size") / 4096).alias("n")
    shared = lambda n: n * F.greatest(F.lit(1), F.ceil(n / BLOCK))  # noqa: E731  texts that blocks of n rows send
    sizes = members.groupBy(group).agg(full())
    wide = members.join(sizes.where(F.col("n") > BLOCK), group)
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring("signature", t * 4 * PATH + 1, F.lit(4 * depth))))
    wide = wide.withColumn("prefixes", prefixes).drop("signature", "n")
    runs = wide.select("*", F.posexplode("prefixes").alias("tree", "run"))
    crowded = runs.groupBy(*group, "run").agg(full(), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
    costs = crowded.groupBy(group).agg(F.sum(shared(F.col("n"))).alias("by_run"))
    chained = tk.stored(sizes.join(costs, group).where((F.col("n") > BLOCK) & (F.col("by_run") < shared(F.col("n")))).select(group), "chained")
    columns = [*group, "run", "tree", "prefixes", "n", "hi", "lo", "rep", "h", "copies"]
    whole = members.join(sizes, group).join(chained, group, "left_anti").select(*group, F.lit(0).cast("bigint").alias("run"), F.lit(0).alias("tree"), F.lit(None).cast("array<bigint>").alias("prefixes"), *columns[5:])
    by_run = runs.join(chained, group, "left_semi").join(crowded, [*group, "run"]).select(columns)
    dealt = graph.in_blocks(whole.union(by_run), BLOCK, F.col("lo")).withColumn("k", F.coalesce("rep", F.lit(-1))).drop("rep")
    texts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("k"), "h", "text").mapInArrow(_once, "k bigint, h bigint, text string")
    keys = [*group, "run", "left", "right"]
    ordered = texts.join(dealt, ["k", "h"]).select(*keys, "tree", "prefixes", "block", "hi", "lo", "copies", "text").repartition(*keys).sortWithinPartitions(*keys, "block", "hi", "lo")
    return tk.stored(ordered.mapInArrow(_verify(width, threshold), "hi bigint, lo bigint, links bigint, hi2 bigint, lo2 bigint"), "compared")
