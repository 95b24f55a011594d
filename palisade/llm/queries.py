"""The registered queries over the text tables, each through its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import (
    attention, centroids, chat, embeddings, infill, mixing, pages, pieces, quality, secrets, simhash, token_counts, toxicity,
)
from palisade.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents")).drop("_row", "removed")


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    formatted = chat.format_turns(rows.union(more), ranks, public_tokenizers.PATTERN)
    return chat.read_back(formatted, ranks, public_tokenizers.PATTERN)


def op7_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.report(table(spark, folder, "documents"))


def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return attention.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_html_extraction": op3_html_extraction,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality_rules": op5_quality_rules,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_secret_scans": op7_secret_scans,
        "op8_mixing": op8_mixing,
        "op9_toxicity": op9_toxicity,
        "op10_simhash": op10_simhash,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_quality_classifier": op12_quality_classifier,
        "op13_centroid_clustering": op13_centroid_clustering,
        "pipeline": corpus_pipeline.run,
    }
