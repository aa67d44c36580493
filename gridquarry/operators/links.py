"""Connected components of a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.shared import stored, unstored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (a, b), any orderable type.  Rows (node, root) for every node with an edge; root is the smallest node reachable.

    Each round ties every node to the smallest of its neighbours and itself, and then contracts:
    both ends of every edge are renamed to what they are tied to, loops go and equal edges
    become one, so later rounds work on ever fewer edges.  At the end the ties are followed
    from the last round to the first.  Minima are taken in part before the shuffle, joins have
    one row for each key on one side, and every round is written to the shared folder.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    ties: list[DataFrame] = []
    while not edges.isEmpty():
        if len(ties) == most_rounds:
            raise RuntimeError(f"edges are left after {most_rounds} rounds")
        both = edges.union(edges.select("b", "a"))
        tied = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "ties")
        ties.append(tied)
        renamed = edges.join(tied.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(tied.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        after = stored(renamed.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        unstored(edges)
        edges = after
    if not ties:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = ties.pop()
    while ties:
        deeper, tied = out, ties.pop()
        up = deeper.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = stored(tied.join(up, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "labels")
        unstored(deeper)
        unstored(tied)
    return out
