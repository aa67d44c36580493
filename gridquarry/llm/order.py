"""Places of rows in an order that no single task ever sorts whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.llm import textkit as tk


def in_order(rows: DataFrame, range_by: list[Column], order: list[Column], name: str = "seq", label: str = "sorted") -> DataFrame:
    """rows, stored, with a number that ascends by `order`, which has to refine `range_by`; it has gaps between partitions.

    Ranges of `range_by` go to partitions of about equal size, each of which is sorted by itself,
    so one hot key spreads as long as what follows it in the order differs.  The numbers
    are written with the rows: a lost task makes its own part again and nothing else.
    """
    dealt = rows.repartitionByRange(*range_by).sortWithinPartitions(*order)
    return tk.stored(dealt.withColumn(name, F.monotonically_increasing_id()), label)


def placed(rows: DataFrame, key: str, order: list[Column], label: str = "placed") -> DataFrame:
    """rows with i, their place from 0 on among the rows of their key (null is a key), and n, how many these are.

    A key's rows in one partition are consecutive, so their first number and how many the
    partitions before hold give every place; only these few numbers for each key and partition meet.
    """
    by = [F.col(key).asc_nulls_first(), *order]
    own = in_order(rows, by, by, "_seq", label).withColumn("_part", F.shiftright("_seq", 33))
    runs = own.groupBy(key, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_c"))
    of = W.partitionBy(key)
    runs = runs.withColumn("n", F.sum("_c").over(of)).withColumn("_before", F.sum("_c").over(of.orderBy("_part")) - F.col("_c"))
    runs = runs.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), "_first", "_before", "n")
    met = own.join(runs, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("i", F.col("_seq") - F.col("_first") + F.col("_before")).drop("_seq", "_part", "_k", "_p", "_first", "_before")
