"""Corpus pipeline: quality, near-duplicates, benchmark passages, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps or changes; `run` writes every
stage's result as Parquet and reads it back for the next. Nulls, repeated rows and empty tables are treated as
the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, minhash, mixing, pii, quality
from riskloom.llm.common import bound_batches
from riskloom.llm.queries import MIX_WEIGHTS, table
from riskloom.session import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    bound_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    bound_batches(spark)
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bound_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the kind in brackets."""
    bound_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mixture draws, with domain, n_tokens and copies."""
    return mixing.mix(docs, weights=MIX_WEIGHTS)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
]

#: A fitted classifier and a similarity join are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_folder(spark, "pipeline", uuid.uuid4().hex)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
