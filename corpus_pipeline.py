"""A pipeline over documents: toxicity, near duplicates, benchmark decontamination, secrets, subword encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and reread as the docs of the next.  All stages but the last return the
columns of documents.  Stages keep clean documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm import decontaminate, neardup, pieces, secrets, toxicity
from gridquarry.llm import textkit as tk
from gridquarry.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go.  The model learns from the labels of documents that came in and are not held out."""
    tk.modest_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~tk.held_out(F.col("doc_id")))
    return toxicity.below(docs, toxicity.fit(docs, labels), 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays."""
    tk.modest_batches(spark)
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if windows of benchmark items cover at least a twentieth of their words."""
    tk.modest_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced, and n_chars follows."""
    tk.modest_batches(spark)
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its subword pieces, and whether they decode to the text."""
    tk.modest_batches(spark)
    found = pieces.round_trip(docs, TOKENIZER)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: Model scores, MinHash and sampling have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tk.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
