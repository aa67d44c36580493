"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridquarry.llm.toxicity import toxicity

    found = toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridquarry.llm.secrets import scan

    found = scan(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: candidate blocks, confirmed licences, and those as license:start:end."""
    from gridquarry.llm.licenses import scan

    found = scan(_read(spark, sf_dir, "documents"))
    told = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.col("n_blocks").cast("bigint").alias("n_blocks"), F.size("licenses").cast("bigint").alias("n_licenses"), F.concat_ws(",", told).alias("licenses"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridquarry.llm.quality import quality

    found = quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridquarry.llm.html import extract

    return extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridquarry.llm.decontaminate import contamination

    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        "contaminated",
        F.size("near").cast("bigint").alias("n_near"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: class, number of links and of copies at word five-grams and similarity 0.8."""
    from gridquarry.llm.neardup import jaccard_join

    return jaccard_join(_read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridquarry.llm.substrings import drop_repeated

    found = drop_repeated(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridquarry.llm.embeddings import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


#: The vocabulary that the registered queries use; its path is a parameter of the operator.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of pieces, a digest of them, and whether decoding gives the text back."""
    from gridquarry.llm.pieces import decode, encode

    found = decode(encode(_read(spark, sf_dir, "documents"), TOKENIZER), TOKENIZER)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third checksum's text is tampered with; what its leaf and the siblings lead to is held against the root."""
    from gridquarry.llm import merkle

    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.hashed([lowered if c == "text" else F.col(c) for c in columns]))
    found = merkle.manifest(_read(spark, sf_dir, "documents"), columns, "lang", "doc_id", {"altered": altered})
    folded = merkle.folded(F.coalesce("altered", "leaf"), F.col("path"))
    told = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage by rule, and what it takes to mend it."""
    from gridquarry.llm import dialogues

    conversations = _read(spark, sf_dir, "conversations")
    return dialogues.Repair(dialogues.damaged(conversations)).report(conversations)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridquarry.llm.onebit import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_licenses, op4_quality, op5_html, op6_decontaminate, op7_jaccard_join, op8_substring_dedup, op9_embedding_dedup, op10_pieces, op11_merkle_manifest, op12_conversation_repair, op13_nearest)}


def oracle_sql() -> dict[str, str]:
    """Scores, Markov spans, alignments, trees and sampled pieces have no SQL; their tests hold them against plain versions."""
    from gridquarry.llm.oracles import ORACLES

    return dict(ORACLES)
