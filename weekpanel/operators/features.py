"""County embeddings to a long feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.fixed_values import FEATURE_SUFFIX
from weekpanel.functions import text
from weekpanel.operators.clean import keep_first
from weekpanel.operators.ranking import running_start


def surplus_duplicates(df: DataFrame, key: str = "fips", null_keys: str = "all") -> DataFrame:
    """Rows beyond the first of each key; 0 when no key repeats.

    Rows without a key are all surplus (``null_keys="all"``), or all but one, as for any other key (``"one"``).
    """
    if null_keys not in ("all", "one"):
        raise ValueError("null_keys must be 'all' or 'one'")
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    first = F.lit(1) if null_keys == "one" else F.col("_key").isNotNull().cast("int")
    return sizes.agg(F.coalesce(F.sum(F.col("n") - first), F.lit(0)).cast("bigint").alias("surplus"))


def dedupe_counties(df: DataFrame, key: str = "fips", order: Sequence[str] | None = None) -> DataFrame:
    """One row per county: the first by ``order``, by default by all other columns.

    A copy whose arrays are null or empty gives way to any other, whatever the order.
    """
    arrays = [name for name, kind in df.dtypes if kind.startswith("array") and name != key]
    usable = [F.when(F.size(c) > 0, 0).otherwise(1) for c in arrays]
    return keep_first(df, [key], [*usable, *(order or [c for c in df.columns if c != key])])


def pad_county(df: DataFrame, col: str = "fips") -> DataFrame:
    """County code as text of five characters with leading zeros."""
    return df.withColumn(col, text.padded_county(F.col(col)))


def union_counties(base: DataFrame, missing: DataFrame) -> DataFrame:
    """Base counties and repaired missing ones, both padded."""
    return pad_county(base).unionByName(pad_county(missing))


def set_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct rows of ``first`` that ``second`` does not have; repeats are merged before the shuffle."""
    return first.distinct().subtract(second.distinct())


def explode_features(df: DataFrame, col: str, group: str = "fips") -> DataFrame:
    """One row per array element: group, index, value. Null and empty arrays give no row."""
    return df.select(group, F.posexplode(col).alias("index", "value"))


def feature_names(df: DataFrame) -> DataFrame:
    """Name each component ``{index}me`` and copy its value to ``group_norm``."""
    name = F.concat(F.col("index").cast("string"), F.lit(FEATURE_SUFFIX))
    return df.withColumns({"feat": name, "group_norm": F.col("value")})


def numbered_features(df: DataFrame, col: str, group: str = "fips") -> DataFrame:
    """The long feature table: ``id, group_id, value, feat, group_norm``, ids 1..n by group and index.

    Each group knows how many rows lie before it from the sizes of the groups alone, so the exploded rows are
    numbered where they arise and are neither shuffled nor sorted. Rows of one group follow each other in an
    order of their content, so repeated groups are numbered the same way in every run.
    """
    groups = df.select(F.col(group).alias("group_id"), F.col(col).alias("_vector")).filter(F.size("_vector") > 0)
    begun = running_start(groups, ["group_id", F.xxhash64("_vector")], F.size("_vector"), out="_before")
    rows = begun.select("_before", "group_id", F.posexplode("_vector").alias("index", "value"))
    return feature_names(rows).select(
        (F.col("_before") + F.col("index") + 1).alias("id"), "group_id", "value", "feat", "group_norm"
    )
