"""A corpus pipeline over ``documents``: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last keep the columns of the documents; the last adds the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekpanel.llm import decontaminate, mixing, near_join, quality, sharding
from weekpanel.llm.shared import Staging, read_table

#: Shares of the domains' own tokens that the mixing stage fits its rates to.
KEEP = {"clean": 1.0, "low": 0.0, "toxic": 0.0}


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_join.one_per_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words or more, in whatever order, go."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at rates within 0 and 1 that are fitted to keep clean tokens and lose the others; fractions are
    realised by a hash of the row."""
    return mixing.mixed_documents(docs, read_table(spark, sf_dir, "labels"), repeat=False, keep=KEEP)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of near equal bytes."""
    return sharding.with_shards(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Trained classifiers and similarity joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with their columns and the shard.

    Each stage defines nulls, empty texts, ties, repeated rows and empty tables as its operator's module says; further
    columns pass through, and a column called ``shard`` stays beside the new one.
    """
    staging = Staging(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staging.write(stage(spark, docs, sf_dir), name)
    return docs
