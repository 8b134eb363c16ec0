"""Registered queries of the operators: one `opN_<name>` each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chatformat, cotrain, exactdedup, mixing, pii, probminhash, suffixdedup, tokenstore
from .common import table


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_classes(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.digests(table(spark, sf_dir, "conversations"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.digests(table(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.every_twentieth(table(spark, sf_dir, "embeddings"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = tokenstore.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return tokenstore.read_shards(shards)


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(table(spark, sf_dir, "documents"))


def op10_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_spans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining": op1_cotraining,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_prob_minhash": op3_prob_minhash,
    "op4_chat_format": op4_chat_format,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_multi_index": op6_multi_index,
    "op7_token_store": op7_token_store,
    "op8_private_data": op8_private_data,
    "op9_source_mix": op9_source_mix,
    "op10_sparse_suffix": op10_sparse_suffix,
}

ORACLE: dict[str, str] = {
    "op4_chat_format": chatformat.ORACLE_SQL,
    "op5_exact_dedup": exactdedup.ORACLE_SQL,
}
