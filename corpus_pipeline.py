"""The corpus pipeline: ``documents`` through five stages, each over all rows that the one before it kept.

Toxic documents go; one document of each group of near duplicates stays; secrets are masked; documents are repeated until the domains'
expected tokens meet their targets; what is left is packed. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from splitmark.llm import jaccard, mixing, packing, secrets, toxicity
from splitmark.llm.common import table
from splitmark.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Targets as multiples of the natural totals. Rates are 1 at least, so a mixture repeats documents and drops none.
MIX = mixing.MixParams(boosts={"q1t0": 1.1}, floor=1.0)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the classifier is learned from the labelled ones outside the held-out fold."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of documents whose five-word shingles are alike at 0.8 or more the one with the smallest id stays."""
    return jaccard.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of secrets in its text are masked."""
    return secrets.remove_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; some stand there again, so that good text makes up its target."""
    return mixing.mixed(docs, mixing.domain_labels(table(spark, sf_dir, "labels")), MIX)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and place in it."""
    return packing.pack(docs, packing.PackParams(tokenizer=public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", jaccard_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: None: SQL can't express a classifier, a signature forest or a tokenizer. The tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
