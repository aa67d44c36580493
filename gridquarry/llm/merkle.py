"""Merkle manifests of datasets: a digest for every row, a tree over each group of rows, and every row's authentication path.

A leaf is the hash of a row's columns; the leaves of a group stand in order, and
while more than one node remains, every FANOUT consecutive ones become their
hash.  The groups' roots, in order of the group, give the root of all in the
same way.

Leaves are dealt out in aligned blocks of FANOUT ** HEIGHT.  Inside a block the
authentication path goes from leaf to leaf by Merkle traversal scheduling: for
each height one treehash stack makes the siblings that are needed next, by one
leaf for each leaf that is passed, and they take over when the path leaves the
siblings before; so the path costs memory that is logarithmic in the block, and
HEIGHT pushes a leaf.  Roots of blocks are the leaves of the next layer up; its
paths are appended to those of all leaves below.  No task sees more than a block.

Defined cases: a null value is `-`, and a null group or id comes first; rows
alike in group and id stand by leaf; a group of one row has its leaf as root;
an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.llm import textkit as tk
from gridquarry.llm.order import placed

FANOUT, HEIGHT = 8, 4
BLOCK = FANOUT**HEIGHT
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def hashed(columns: list[Column]) -> Column:
    """sha256 of the values end to end: each its length in bytes, a colon and its text, or a hyphen for null."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[told(c.cast("string")) for c in columns]), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels that are hashed over n nodes, HEIGHT at most: a block of a larger group is full, or the last, which is hashed as high."""
    levels = 0
    while n > 1 and levels < HEIGHT:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Treehash:
    """Nodes of one height from leaves that come one by one; below it wait at most FANOUT - 1 nodes of each height."""

    def __init__(self, top: int):
        self.nodes: list[list[str]] = [[] for _ in range(top + 1)]

    def push(self, leaf: str) -> None:
        self.nodes[0].append(leaf)
        for h in range(len(self.nodes) - 1):
            if len(self.nodes[h]) < FANOUT:
                return
            self.nodes[h + 1].append(digest(self.nodes[h]))
            self.nodes[h] = []

    def taken(self) -> list[str]:
        """The nodes; a last run that is not full counts as it is."""
        for h in range(len(self.nodes) - 1):
            if self.nodes[h]:
                self.nodes[h + 1].append(digest(self.nodes[h]))
                self.nodes[h] = []
        out, self.nodes[-1] = self.nodes[-1], []
        return out


def traversal(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn, the siblings left and right of its path on each level."""
    n = len(leaves)
    reach = [FANOUT ** (h + 1) for h in range(levels)]
    stacks = [Treehash(h) for h in range(levels)]
    groups: list[list[str]] = []
    for h in range(levels):
        for leaf in leaves[: reach[h]]:
            stacks[h].push(leaf)
        groups.append(stacks[h].taken())
    sides = [("", "")] * levels
    for s in range(n):
        for h in range(levels):
            width = reach[h] // FANOUT
            if s % width:
                break
            at = s // width % FANOUT
            sides[h] = "".join(groups[h][:at]), "".join(groups[h][at + 1 :])
        yield list(sides)
        for h in range(levels):
            ahead = s + reach[h]
            if ahead < n:
                stacks[h].push(leaves[ahead])
            if (s + 1) % reach[h] == 0:
                groups[h] = stacks[h].taken()


def _blocks(batches: Iterator[pa.RecordBatch], begins: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[pa.Table]:
    """Rows between one beginning of a block and the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cuts = [0, *[k for k in pc.indices_nonzero(begins(batch)).to_pylist() if k], batch.num_rows]
        for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if held and (k or begins(batch.slice(0, 1))[0].as_py()):
                yield pa.Table.from_batches(held)
                held = []
            if high > low:
                held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, lambda b: pc.equal(pc.bit_wise_and(b.column("i"), BLOCK - 1), 0)):
        n = block["n"][0].as_py()
        stack = Treehash(height(n))
        for leaf in block["digest"].to_pylist():
            stack.push(leaf)
        (root,) = stack.taken()
        yield pa.RecordBatch.from_arrays([block["key"].slice(0, 1).combine_chunks(), pa.array([block["i"][0].as_py() // BLOCK]), pa.array([-(-n // BLOCK)]), pa.array([root])], names=["key", "i", "n", "digest"])


def roots(nodes: DataFrame) -> DataFrame:
    """nodes: key, i, n, digest, each key's places without gaps.  The roots of their blocks, as nodes of the next layer."""
    own = nodes.select("key", "i", "n", "digest", F.shiftright("i", 12).alias("_b"))
    dealt = own.repartition("key", "_b").sortWithinPartitions("key", "_b", "i").drop("_b")
    return dealt.mapInArrow(_rooted, nodes.select("key", "i", "n", "digest").schema)


assert BLOCK == 1 << 12, "blocks are found by shifting"


def _pathed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, lambda b: pc.equal(b.column("i"), -1)):
        upper, rows = block.slice(0, 1), block.slice(1)
        above = [(x["left"], x["right"]) for x in upper["path"][0].as_py()]
        left: list[str] = []
        right: list[str] = []
        offsets = [0]
        for sides in traversal(rows["digest"].to_pylist(), height(rows["n"][0].as_py())):
            for a, b in (*sides, *above):
                left.append(a)
                right.append(b)
            offsets.append(len(left))
        told = {c: pa.array(upper[c].to_pylist() * rows.num_rows, pa.string()) for c in ("subroot", "root")}
        told["path"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])).cast(_PATH)
        yield from pa.table({c: told.get(c, rows[c]) for c in rows.column_names}).to_batches(1024)


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes (key, i, n, digest and more) with path, subroot and root, from those of the layer above, whose i is the block's."""
    more = [c for c in nodes.columns if c not in ("key", "i", "n", "digest")]
    columns = ["key", "i", "n", "digest", "path", "subroot", "root", *more]
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(nodes.dtypes)
    head = above.select("key", F.col("i").alias("_b"), F.lit(-1).cast("bigint").alias("i"), "n", "digest", "path", "subroot", "root", *(none(kinds[c]).alias(c) for c in more))
    own = nodes.select("key", F.shiftright("i", 12).alias("_b"), "i", "n", "digest", none(PATH).alias("path"), none("string").alias("subroot"), none("string").alias("root"), *more)
    dealt = head.unionByName(own).repartition("key", "_b").sortWithinPartitions("key", "_b", "i").select(columns)
    return dealt.mapInArrow(_pathed, dealt.schema)


def _layers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and the layers above them, up to one node for each key; a layer is a BLOCK-th of the one below."""
    out = [nodes]
    while True:
        most = out[-1].agg(F.max("n")).first()[0]
        if most is None or most == 1:
            return out
        out.append(tk.stored(roots(out[-1]), "layer"))


def _down(layers: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the lowest layer, from those of the highest."""
    for layer in layers[-2::-1]:
        top = paths(layer, top)
    return top


def manifest(rows: DataFrame, columns: list[str], group: str, id_col: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: id, leaf, subroot, root, path (siblings left and right, level by level), and the extra columns asked for.

    `folded` leads from a leaf and its path to a root.
    """
    extra = extra or {}
    leaves = rows.select(F.col(group).cast("string").alias("key"), F.col(id_col).alias("id"), hashed([F.col(c) for c in columns]).alias("digest"), *(c.alias(f"x_{name}") for name, c in extra.items()))
    salt = leaves.withColumn("_salt", F.monotonically_increasing_id())
    nodes = placed(salt, "key", [F.col("id").asc_nulls_first(), F.col("digest"), F.col("_salt")], "leaves").drop("_salt")
    nodes = tk.stored(nodes, "nodes")
    layers = _layers(nodes)
    subroots = layers[-1].select(F.lit("").alias("group"), "key", "digest")
    tops = placed(subroots, "group", [F.col("key").asc_nulls_first()], "subroots").select(F.col("group").alias("key"), "i", "n", "digest", F.col("key").alias("of"))
    tops = tk.stored(tops, "tops")
    over = _layers(tops)
    blank = F.array().cast(PATH)
    summit = over[-1].select("key", "i", "n", "digest", blank.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), *(["of"] if len(over) == 1 else []))
    told = tk.stored(_down(over, summit), "told").select(F.col("of").alias("key"), F.col("digest").alias("subroot"), "root", "path")
    ids = [c for c in nodes.columns if c not in ("key", "i", "n", "digest")]
    if len(layers) == 1:
        found = nodes.join(told, nodes["key"].eqNullSafe(told["key"])).drop(told["key"])
    else:
        head = told.select("key", F.lit(0).cast("bigint").alias("i"), F.lit(1).cast("bigint").alias("n"), F.col("subroot").alias("digest"), "path", "subroot", "root")
        found = _down(layers, head)
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", *(F.col(c).alias(c[2:]) for c in ids if c != "id"))


def proof(path: Column) -> Column:
    """All siblings of a path, end to end."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))
