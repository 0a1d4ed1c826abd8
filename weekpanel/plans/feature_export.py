"""County embeddings, with repaired missing counties, to a numbered long feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekpanel.operators import features
from weekpanel.sources import readers, writers


def county_feature_table(base: DataFrame, missing: DataFrame, col: str = "weighted_embedding") -> DataFrame:
    """Long features of the base counties and of the missing ones, each of the latter once."""
    counties = features.union_counties(base.select("fips", col), features.dedupe_counties(missing.select("fips", col)))
    return features.numbered_features(counties, col)


def write_feature_table(
    spark: SparkSession, base: str, missing: str, path: str, col: str = "weighted_embedding"
) -> DataFrame:
    """The feature table of two Parquet globs, written as CSV without a header.

    Returns the audit of the missing counties: how many of their rows were surplus.
    """
    repaired = readers.read_embeddings(spark, missing)
    table = county_feature_table(readers.read_embeddings(spark, base), repaired, col)
    writers.write_csv(table, path, header=False)
    return features.surplus_duplicates(repaired)
