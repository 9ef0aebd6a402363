"""One query an operator, each over its whole table; the SQL twins of those that SQL can express are in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import ann, chat, lines, mixing, neardup, ogg, packing, quality, rollups, warc
from marketloom.llm.common import read_table
from marketloom.llm.tokens import public_path

BPE = "byte_bpe_50k.json"
#: The conversation that op6 adds: its texts are made of control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_ogg(ogg.to_ogg(read_table(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_table(spark, sf_dir, "documents"), public_path(BPE), keep=["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "selected")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2, numPartitions=1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    return chat.read_back(chat.assemble(turns.unionByName(added), public_path(BPE)), public_path(BPE))


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.corpus_rollup(read_table(spark, sf_dir, "documents"), public_path(BPE), "byte_bpe_50k")


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those kept, and length and SHA-256 of the text they make."""
    out = lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_kept", F.length(text).alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read_table(spark, sf_dir, "documents"), public_path(BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_index, op2_cross_polytope_ann, op3_ogg_media, op4_quality_classifier, op5_source_mixing, op6_chat_format, op7_token_rollups, op8_minhash_neardup, op9_fuzzy_line_dedup, op10_best_fit_packing)}
