"""Cleaning: null keys, mentions, retweets, URLs, counties, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.functions import text
from weekpanel.operators.hot_join import salted_join
from weekpanel.session import stage

MESSAGE_KEYS = ("user_id", "message_id", "created_at")


def require_keys(df: DataFrame, cols: Sequence[str] = MESSAGE_KEYS) -> DataFrame:
    """Keep rows in which none of ``cols`` is null."""
    return df.dropna(subset=list(cols))


def mask_mentions(df: DataFrame, col: str = "message") -> DataFrame:
    """Replace every ``@name`` by a mask. E-mail domains are hit too: ``a@b.com`` becomes ``a<USER>.com``."""
    return df.withColumn(col, text.masked_mentions(F.col(col)))


def drop_retweets(df: DataFrame, col: str = "message") -> DataFrame:
    """Drop messages that begin with ``RT @name:``, and null messages."""
    return df.filter(~text.is_retweet(F.col(col)))


def drop_urls(df: DataFrame, col: str = "message") -> DataFrame:
    """Drop messages that contain an http(s) URL, and null messages."""
    return df.filter(~text.has_url(F.col(col)))


def county_valid(df: DataFrame, col: str = "fips") -> DataFrame:
    """Keep five-digit county codes."""
    return df.filter(text.is_county(F.col(col)))


def county_invalid(df: DataFrame, col: str = "fips") -> DataFrame:
    """Keep codes that are not five digits. Null is dropped here as well as by :func:`county_valid`."""
    return df.filter(~text.is_county(F.col(col)))


def county_short(df: DataFrame, col: str = "fips") -> DataFrame:
    """Keep codes of one to four digits: those that lost their leading zeros."""
    return df.filter(text.is_short_county(F.col(col)))


def parse_created_at(df: DataFrame, col: str = "created_at") -> DataFrame:
    """Text to timestamp; null where the text is no timestamp."""
    return df.withColumn(col, F.col(col).try_cast("timestamp"))


def attach_county(
    messages: DataFrame, user_county: DataFrame, county_col: str = "fips", split_hot: bool = False
) -> DataFrame:
    """Inner join on the user. Unmapped users drop out; a user with several counties fans out.

    No broadcast is forced: the planner broadcasts the map while its size is below the session's threshold
    and otherwise shuffles by user, where adaptive execution splits the partition of a hot user. ``split_hot``
    splits hot users in the plan, for one more pass over the users of the messages.
    """
    counties = user_county.select("user_id", F.col("cnty").alias(county_col))
    if split_hot:
        return salted_join(messages, counties, "user_id")
    return messages.join(counties, "user_id", "inner")


def first_county(user_county: DataFrame) -> DataFrame:
    """One county per user: the smallest, null only where the user has no other. Staged, see :func:`stage`.

    Of the copies of a message that differ in nothing but the county, :func:`dedupe_messages` keeps the one with
    the smallest. Reducing the map before the join gives the same survivors and never builds the other copies,
    however many counties a user has.
    """
    named = user_county.filter(F.col("user_id").isNotNull())
    return stage(named.groupBy("user_id").agg(F.min("cnty").alias("cnty")), "counties")


def county_counts(user_county: DataFrame) -> DataFrame:
    """Number of map rows per user, staged: how many copies of a message :func:`attach_county` would give."""
    named = user_county.filter(F.col("user_id").isNotNull())
    return stage(named.groupBy("user_id").agg(F.count("*").alias("copies")), "copies")


def county_map(user_county: DataFrame) -> DataFrame:
    """Per user the county of :func:`first_county` and the ``copies`` of :func:`county_counts`, staged."""
    named = user_county.filter(F.col("user_id").isNotNull())
    return stage(named.groupBy("user_id").agg(F.min("cnty").alias("cnty"), F.count("*").alias("copies")), "county-map")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first by ``order`` (ascending, nulls last).

    ``rank = 1`` directly over the window lets Spark also cut each group to one row *before* the shuffle, so a
    key that holds a third of all rows sends one row per input partition and no task gathers the group.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = Window.partitionBy(*keys).orderBy(*[c.asc_nulls_last() for c in columns])
    return df.withColumn("_place", F.row_number().over(ordered)).filter(F.col("_place") == 1).drop("_place")


def dedupe_messages(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One row per ``message_id``.

    By default all columns take part in the order, the short ones first: earliest, then smallest user, county
    and user-week, then the texts. The survivor is therefore always the same one, and its short columns do not
    depend on whether the texts take part, which lets counting jobs leave the texts out of the shuffle.
    """
    if order is None:
        short = [c for c in ("created_at", "user_id", "fips", "user_year_week") if c in df.columns]
        order = short + [c for c in df.columns if c not in short and c != "message_id"]
    return keep_first(df, ["message_id"], order)
