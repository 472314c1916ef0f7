"""Corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Every stage but the last returns the columns of documents. Quality rules drop what they
reject; near-dedup keeps one document of each component; the secret scan replaces secrets
in the text; mixing repeats the rarer sources' documents up to their weights (its budget is
what the most frequent source fills once, so it drops none); the last encodes each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradus.llm import bpe, mixing, quality, secrets, simhash
from gradus.llm._common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mixing", mix_sources),
    ("bpe encoding", encode),
]

#: The quality verdict, the fingerprints and the tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
