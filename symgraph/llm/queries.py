"""The queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, quality_rules, warc
from .common import documents


def tokenizer_file(name: str) -> str:
    """The vocabulary folder is a parameter: TOKENIZER_DIR, or where ``public_tokenizers`` is installed."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digests

    return bpe_digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect_pii

    return detect_pii(documents(spark, sf_dir)).drop("found")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op7_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import embedding_links

    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("repeats")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.ORACLE_SQL, "op6_quality_rules": quality_rules.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL}
