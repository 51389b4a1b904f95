"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, chat, fingerprints, jaccard, langid, mpegts, packing, secret_scan, shards, simple8b

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.matched_fingerprints(_table(spark, sf_dir, "documents"))


def op2_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prefix_tree(_table(spark, sf_dir, "conversations"))


def op3_token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_words(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_links(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.minimax_shards(_table(spark, sf_dir, "documents"), F.octet_length("text"), ["source", "doc_id"])


def op8_elementary_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    media = pages.select("page_id", mpegts.transport_stream(F.col("html"), F.col("page_id")).alias("media"))
    return mpegts.elementary_packets(media, "page_id", "media")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_fingerprints, op2_prefix_tree, op3_token_words, op4_language, op5_near_groups, op6_bpe, op7_shards, op8_elementary_packets, op9_secrets, op10_packing)}
ORACLE: dict[str, str] = {"op7_shards": shards.oracle(), "op9_secrets": secret_scan.oracle()}
