"""Queries of this subpackage, each over its whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, chat, compression, decontam, lm, mixing, neardup, quality, sharding, substrings, tokens, variants, warc
from .common import table


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their long repeated strings."""
    return substrings.op1(table(spark, sf_dir, "documents"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their token counts."""
    return tokens.op2(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from each speaker's perspective."""
    return chat.op3(table(spark, sf_dir, "conversations"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    return sharding.op4(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources mixed to weights 1, 2, 3."""
    return mixing.op5(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived and read back."""
    return warc.op6(table(spark, sf_dir, "pages"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of their near copies."""
    return neardup.op7(table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored."""
    return lm.op8(table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontam.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged."""
    return quality.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words and forms."""
    return variants.op11(table(spark, sf_dir, "documents"))


def op12_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by compression."""
    return compression.op12(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between two tokenizers."""
    return align.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffixes": op1_suffixes,
    "op2_tokens": op2_tokens,
    "op3_chat": op3_chat,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_neardup": op7_neardup,
    "op8_lm": op8_lm,
    "op9_decontam": op9_decontam,
    "op10_quality": op10_quality,
    "op11_variants": op11_variants,
    "op12_compression": op12_compression,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = {"op3_chat": chat.ORACLE, "op6_warc": warc.ORACLE}
