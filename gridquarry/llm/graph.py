"""Groups of linked rows and connected components, without collecting links or components anywhere.

Nodes are numbered by two 64-bit halves of a digest, (hi, lo), so that they need
no driver-side numbering and depend on nothing but their content.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.operators.links import components

__all__ = ["components", "forest", "in_blocks"]


def in_blocks(members: DataFrame, limit: int, salt: Column) -> DataFrame:
    """Deal each group's rows out to blocks of about `limit` rows, and each block to all pairs of blocks it belongs to.

    Column n has the size of a row's group; it is replaced by block, left and right.  Every two
    rows of a group meet in exactly one (group, left, right), where left <= right, so a group of
    any size is compared in pieces of at most two blocks.  Rows of one block meet in (block, block).
    """
    dealt = members.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("n") / limit)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.hash(salt), F.col("_n")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right")))
    return dealt.withColumn("_p", F.explode(others)).withColumn("left", F.col("_p.left")).withColumn("right", F.col("_p.right")).drop("_p", "_n", "n")


def forest(linked: np.ndarray) -> np.ndarray:
    """linked: a symmetric boolean matrix.  The smallest row number reachable from each row."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low
