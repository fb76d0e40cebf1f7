"""The queries of this package and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from splitmark.llm import chat, fingerprint, jaccard, langid, mixing, packing, quality, secrets, topk, toxicity
from splitmark.llm.common import table


#: Mostly good text, a little of the rest.
MIX = mixing.MixParams(weights={"q1t0": 0.9, "q0t0": 0.06, "q1t1": 0.03})


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.domain_labels(table(spark, sf_dir, "labels")), MIX)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op10_secret_scan(table(spark, sf_dir, "documents"))


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op1_winnowing(table(spark, sf_dir, "documents"))


def op2_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2_neighbour_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4_conv_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op6_typed_parts(table(spark, sf_dir, "conversations"))


def op7_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.PackParams(tokenizer=public_tokenizers.path("word_bpe_49k.json")))


def op8_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op8_compression_langid(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": op1_winnowing,
    "op2_neighbour_quality": op2_neighbour_quality,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_conv_toxicity": op4_conv_toxicity,
    "op5_jaccard_forest": op5_jaccard_forest,
    "op6_typed_parts": op6_typed_parts,
    "op7_first_fit_packing": op7_first_fit_packing,
    "op8_compression_langid": op8_compression_langid,
    "op9_soft_mixing": op9_soft_mixing,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": topk.ORACLE_SQL,
    "op6_typed_parts": chat.ORACLE_SQL,
}
