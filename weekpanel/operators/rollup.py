"""Weighted county-week scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.fixed_values import DEFAULT_USER_WEIGHT, SCORE_FEATURES
from weekpanel.operators.hot_join import salted_join
from weekpanel.operators.ranking import sample_rows
from weekpanel.session import stage

GROUP = "year_week_county"


def attach_weights(
    scores: DataFrame, weights: DataFrame, unique: bool = False, split_hot: bool = False
) -> DataFrame:
    """Left join on the user. Several weight rows of a user fan out; with ``unique`` they raise instead.

    The checked weights are staged so that adaptive execution can split a hot user in the join; ``split_hot`` splits
    hot users in the plan.
    """
    if unique:
        rest = [c for c in weights.columns if c != "user_id"]
        repeated = F.raise_error(F.concat(F.lit("several weights for user "), F.col("user_id").cast("string")))
        named = weights.filter(F.col("user_id").isNotNull())
        checked = (
            named.groupBy("user_id")
            .agg(F.count("*").alias("_rows"), F.min(F.struct(*rest)).alias("_row"))
            .withColumn("_row", F.when(F.col("_rows") == 1, F.col("_row")).otherwise(repeated))
        )
        weights = stage(checked.select("user_id", *[F.col("_row")[c].alias(c) for c in rest]), "weights")
    return salted_join(scores, weights, "user_id", "left") if split_hot else scores.join(weights, "user_id", "left")


def default_weight(df: DataFrame, value: float = DEFAULT_USER_WEIGHT, col: str = "weight") -> DataFrame:
    """Null weight to ``value``."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(float(value))))


def county_fallback(df: DataFrame, col: str = "cnty", fallback: str = "fips") -> DataFrame:
    """The home county, or the observed one where it is null."""
    return df.withColumn(col, F.coalesce(F.col(col), F.col(fallback)))


def county_null_counts(df: DataFrame, col: str = "cnty", fallback: str = "fips") -> DataFrame:
    """Null counties before and after :func:`county_fallback`, in one pass."""
    return df.agg(
        F.count_if(F.col(col).isNull()).alias("null_before"),
        F.count_if(F.coalesce(F.col(col), F.col(fallback)).isNull()).alias("null_after"),
    )


def county_mismatch(df: DataFrame, first: str = "fips", second: str = "cnty") -> DataFrame:
    """Rows whose two counties differ; a null on either side is no difference."""
    return df.filter(F.col(first) != F.col(second))


def county_mismatch_sample(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` differing rows by ``order``."""
    return sample_rows(county_mismatch(df), order, n)


def labelled(df: DataFrame, label: str, col: str = "feat") -> DataFrame:
    """Add a constant text column."""
    return df.withColumn(col, F.lit(label))


def melt_scores(
    df: DataFrame,
    features: Mapping[str, str] = SCORE_FEATURES,
    ids: Sequence[str] = ("user_id", GROUP, "fips", "user_weight"),
) -> DataFrame:
    """One row per feature: ``feat`` and ``feat_score``. The input is read once, not once per feature."""
    named = df.select(*ids, *[F.col(c).alias(feat) for feat, c in features.items()])
    return named.unpivot(list(ids), list(features), "feat", "feat_score")


def union_targets(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two long score tables; :func:`melt_scores` gives the same rows from one scan."""
    return first.unionByName(second)


def _weight(score: Column, weight: Column, null_weights: str) -> Column:
    if null_weights == "keep":
        return weight
    if null_weights == "drop":
        return F.when(score.isNotNull(), weight)
    raise ValueError("null_weights must be 'keep' or 'drop'")


def _weighted_deviation(score: Column, weight: Column, total: Column) -> Column:
    """The root of sum(w (s - m)^2) / total around the weighted mean m = sum(w s) / total, from mergeable moments.

    With a the plain mean of the scores, n their number and d = s - a, co-moments give sum(w d) = n cov(w, s) and
    sum(w d^2) = n (cov(w s, s) - a cov(w, s)): Spark merges them around running means, so scores far from zero do not
    cancel. m is then a + (sum(w d) - a * weight of null scores) / total, and the sum around m follows from the sums
    around a. Rows without a score or a weight are in none of the moments.
    """
    both = score.isNotNull() & weight.isNotNull()
    present, heavy = F.when(both, score), F.when(both, weight)
    n, mean = F.count(present), F.avg(present)
    first = n * F.covar_pop(heavy, present)
    second = n * F.covar_pop(heavy * present, present) - mean * first
    scored = F.sum(heavy)
    off = F.try_divide(first - mean * (total - scored), total)
    square = second - 2 * off * first + off * off * scored
    return F.sqrt(F.try_divide(F.greatest(square, F.lit(0.0)), total))


def _statistics(score: Column, weight: Column, null_weights: str, weighted_std: bool = False) -> dict[str, Column]:
    total = F.sum(_weight(score, weight, null_weights))
    out = {
        "wavg_score": F.try_divide(F.sum(score * weight), total),
        "avg_score": F.avg(score),
        "std_score": F.stddev_pop(score),
    }
    if weighted_std:
        out["std_score_wt"] = _weighted_deviation(score, weight, total)
    return out


def county_week_rollup(
    long_scores: DataFrame, null_weights: str = "keep", weighted_std: bool = False
) -> DataFrame:
    """Per county-week and feature: weighted mean, mean, population deviation and number of users.

    A null score still adds its weight to the weighted mean unless ``null_weights="drop"``. ``weighted_std``
    adds ``std_score_wt``, the deviation around the weighted mean, in the same pass. Users are counted through a first shuffle on group and user, with partial sums before it, so
    one heavy county-week is spread over many tasks.
    """
    statistics = _statistics(F.col("feat_score"), F.col("user_weight"), null_weights, weighted_std)
    return long_scores.groupBy(GROUP, "feat").agg(
        *[c.alias(name) for name, c in statistics.items()], F.count_distinct("user_id").alias("N_users")
    )


def county_week_rollup_wide(
    scores: DataFrame, features: Mapping[str, str] = SCORE_FEATURES, null_weights: str = "keep", weighted_std: bool = False
) -> DataFrame:
    """The rows of ``county_week_rollup(melt_scores(scores))``, melted after the aggregation instead of before.

    All features of a row are aggregated together, so the shuffle carries one row per group and user instead
    of one per feature, and users are counted once.
    """
    fields = {
        feat: _statistics(F.col(col), F.col("user_weight"), null_weights, weighted_std) for feat, col in features.items()
    }
    wide = scores.groupBy(GROUP).agg(
        *[c.alias(f"{feat}_{name}") for feat, statistics in fields.items() for name, c in statistics.items()],
        F.count_distinct("user_id").alias("N_users"),
    )
    rows = [
        F.struct(F.lit(feat).alias("feat"), *[F.col(f"{feat}_{name}").alias(name) for name in statistics])
        for feat, statistics in fields.items()
    ]
    return wide.select(GROUP, F.inline(F.array(*rows)), "N_users")


def rollup_group_count(rollup: DataFrame) -> DataFrame:
    """Number of result groups."""
    return rollup.agg(F.count(F.lit(1)).alias("groups"))
