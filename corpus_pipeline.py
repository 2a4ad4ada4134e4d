"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages run() writes a table to the shared folder
and reads it again. All stages but the last return the columns of documents; the last adds the shard that holds a row.
A document that the mix takes twice stands in its result twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithos.llm import op1_sharding, op5_mixing, op6_minhash, op8_quality, op9_decontaminate
from lithos.llm.shared import shared_dir, stored, table
from lithos.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    ship_package(spark)
    return op8_quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship_package(spark)
    return op6_minhash.first_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship_package(spark)
    return op9_decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship_package(spark)
    return op5_mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the compacted shard store, with their shards."""
    ship_package(spark)
    return op1_sharding.shard(docs, shared_dir(spark, "corpus"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: SQL has no Order MinHash; the tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
