"""A training corpus from documents: quality rules, near copies, identifiers, mixing, packing.

Each stage reads what the one before it wrote and works on all of it; all but the last return the
columns of documents. Rows with null or empty texts fall to the quality rules; an empty table of documents
or labels gives an empty result or keeps what has words. What else the stages do with nulls, very long
texts, ties, repeated rows and other columns is said in the operators' modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamspark.llm import mixing, packing, pii, quality_rules, simhash_dedup
from loamspark.sources import shared

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a risk-controlled rule rejects go."""
    return quality_rules.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_dedup.without_copies(docs)


def identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of persons are replaced by their kind."""
    return pii.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their target shares: a document is there as often as it was drawn."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut and packed into bins: a row for each piece."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_dedup", near_copies),
    ("pii", identifiers),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express fingerprints, transducers and best fit; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is written to the folder that executors share, and deleted once the next one is."""
    folder = shared.folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            shared.delete(spark, f"{folder}/{before}")
        before = name
    return docs
