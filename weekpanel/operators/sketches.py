"""Panel statistics that can be united: per batch counted once, asked for any set of batches without their messages.

Messages are exact, since an id is in one batch only. Counties are exact: their codes are numbers below 100,000, kept as
bitmaps (codes that are no such number share one place of their own each, see :func:`summarised`). User-weeks and users
are sketches: with ``LG_K`` = 14 their standard error is 1.04 / sqrt(2^14) = 0.8 %, and up to some thousand values they
are exact to a few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "user_year_week"
LG_K = 14
#: Three standard errors of a united sketch.
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
COUNTY_CODES = 100_000
SUMMARY_SCHEMA = "batch bigint, messages bigint, weeks_sketch binary, users_sketch binary"
COUNTY_SCHEMA = "batch bigint, bucket bigint, bits binary"


def summarised(members: DataFrame) -> DataFrame:
    """One row per batch: messages, and the sketches of its user-weeks and users. Nulls are not counted."""
    return members.groupBy(F.col("batch").cast("bigint").alias("batch")).agg(
        F.count("message_id").alias("messages"),
        F.hll_sketch_agg(KEY, LG_K).alias("weeks_sketch"),
        F.hll_sketch_agg(F.col("user_id").cast("bigint"), LG_K).alias("users_sketch"),
    )


def county_bitmaps(members: DataFrame) -> DataFrame:
    """(batch, bucket, bits): the counties of each batch. Codes that are no five digits do not count."""
    code = F.when(F.col("fips").rlike("^[0-9]{5}$"), F.col("fips").cast("bigint"))
    coded = members.select(F.col("batch").cast("bigint").alias("batch"), code.alias("code")).filter("code IS NOT NULL")
    return coded.groupBy("batch", F.bitmap_bucket_number("code").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits")
    )


def united_statistics(summaries: DataFrame, counties: DataFrame) -> DataFrame:
    """One row over all given batches: messages, user_weeks, users and counties, as of ``activity.panel_stats``."""
    totals = summaries.agg(
        F.coalesce(F.sum("messages"), F.lit(0)).cast("bigint").alias("messages"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("weeks_sketch")), F.lit(0)).cast("bigint").alias("user_weeks"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users_sketch")), F.lit(0)).cast("bigint").alias("users"),
    )
    buckets = counties.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    known = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("counties"))
    return totals.withColumn("counties", known.scalar())
