"""A training-data pipeline over the documents table, as a list of stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what a stage returns as Parquet in
the shared folder and reads it again as the next one's documents, so that a lost executor costs at most the stage
that runs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opslens.llm import line_dedup, mixing, packing, quality_rules, simhash
from opslens.llm.common import table
from opslens.session import stage

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.apply(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds."""
    return line_dedup.apply(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies."""
    return simhash.apply(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for every reading."""
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the training sequences."""
    return packing.digest(docs, VOCABULARY)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_copies),
    ("mixing", mix),
    ("packing", pack),
]

# XXH64 fingerprints, token ids and the packing are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
