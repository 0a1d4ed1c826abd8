"""User-week scores to weighted county-week scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.fixed_values import DEFAULT_USER_WEIGHT, SCORE_FEATURES
from weekpanel.operators import calendar, rollup
from weekpanel.sources import readers, writers


def weighted_scores(
    scores: DataFrame,
    weights: DataFrame,
    *,
    default: float = DEFAULT_USER_WEIGHT,
    unique: bool = False,
    layout: str = calendar.WEEK_FIRST,
) -> DataFrame:
    """Scores with ``user_weight`` and ``year_week_county``. ``layout`` is that of the user-week keys."""
    weighted = rollup.default_weight(rollup.attach_weights(scores, weights, unique), default)
    return calendar.county_week_key(weighted.withColumnRenamed("weight", "user_weight"), layout=layout)


def county_week_scores(
    scores: DataFrame,
    weights: DataFrame,
    *,
    features: Mapping[str, str] = SCORE_FEATURES,
    null_weights: str = "keep",
    weighted_std: bool = False,
    unique: bool = False,
    layout: str = calendar.WEEK_FIRST,
) -> DataFrame:
    """One row per county-week and feature; the features are aggregated together and melted afterwards."""
    weighted = weighted_scores(scores, weights.select("user_id", "weight"), unique=unique, layout=layout)
    return rollup.county_week_rollup_wide(weighted, features, null_weights, weighted_std)


def county_diagnostics(scores: DataFrame, homes: DataFrame) -> DataFrame:
    """One row: null home counties before and after the fallback to the observed one, and rows where the two differ.

    ``homes`` is a table of users with ``cnty``, such as weights that carry it; several rows of a user fan out.
    """
    beside = rollup.attach_weights(scores.select("user_id", "fips"), homes.select("user_id", "cnty"))
    differing = rollup.county_mismatch(beside).agg(F.count(F.lit(1)).alias("differing")).scalar()
    return rollup.county_null_counts(beside).withColumn("differing", differing)


def write_county_weeks(spark: SparkSession, scores: str, weights: str, path: str, **options) -> DataFrame:
    """County-weeks from a CSV of scores and one of weights, written as one CSV file with a header, and returned.

    Options are those of :func:`county_week_scores`.
    """
    weeks = county_week_scores(readers.read_scores(spark, scores), readers.read_weights(spark, weights), **options)
    writers.write_csv(weeks, path, files=1)
    return weeks
