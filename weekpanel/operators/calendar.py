"""Calendar parts, and the text keys that name a user-week or a county-week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The two text layouts of a user-week key.
USER_FIRST = "user_first"  # 42:2021-5
WEEK_FIRST = "week_first"  # 2021_05:42


def calendar_parts(df: DataFrame, year: str = "calendar", col: str = "created_at") -> DataFrame:
    """Add ``date_only``, ``year`` and ISO ``week``.

    ``year="calendar"`` pairs the calendar year with the ISO week (1 January 2021 is week 53 of 2021);
    ``year="iso"`` takes the year that owns the ISO week (week 53 of 2020).
    """
    if year not in ("calendar", "iso"):
        raise ValueError("year must be 'calendar' or 'iso'")
    date = F.to_date(col)
    number = F.year(date) if year == "calendar" else F.extract(F.lit("YEAROFWEEK"), date)
    return df.withColumns({"date_only": date, "year": number, "week": F.weekofyear(date)})


def in_year(df: DataFrame, year: int, col: str = "created_at") -> DataFrame:
    """Keep one calendar year, as a range on the timestamp itself so that a Parquet scan can skip row groups.

    The bounds are text: they take the column's own type, with or without time zone, when the plan is analysed.
    """
    start, end = (F.lit(f"{y:04d}-01-01 00:00:00") for y in (year, year + 1))
    return df.filter((F.col(col) >= start) & (F.col(col) < end))


def build_key(df: DataFrame, layout: str = USER_FIRST, out: str = "user_year_week") -> DataFrame:
    """Render ``user_id``, ``year`` and ``week`` as one text key."""
    user, year, week = (F.col(c).cast("string") for c in ("user_id", "year", "week"))
    if layout == USER_FIRST:
        key = F.concat(user, F.lit(":"), year, F.lit("-"), week)
    elif layout == WEEK_FIRST:
        key = F.concat(year, F.lit("_"), F.lpad(week, 2, "0"), F.lit(":"), user)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return df.withColumn(out, key)


def split_key(df: DataFrame, layout: str = USER_FIRST, col: str = "user_year_week") -> DataFrame:
    """Parse a text key into ``key_user``, ``key_year`` and ``key_week``; null where a part is missing."""
    if layout == USER_FIRST:
        pattern, places = r"^(-?\d+):(\d+)-(\d+)$", (1, 2, 3)
    elif layout == WEEK_FIRST:
        pattern, places = r"^(\d+)_(\d+):(-?\d+)$", (3, 1, 2)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    user, year, week = (F.regexp_extract(col, pattern, place) for place in places)
    return df.withColumns(
        {"key_user": user.try_cast("bigint"), "key_year": year.try_cast("int"), "key_week": week.try_cast("int")}
    )


def county_week_key(
    df: DataFrame,
    col: str = "user_year_week",
    county: str = "fips",
    out: str = "year_week_county",
    layout: str = WEEK_FIRST,
) -> DataFrame:
    """The year-week of the user-week key, then ``_`` and the county; null if either is null.

    With the week first it is the text before the first ``:``, all of it if there is none; with the user first
    it is the text after.
    """
    if layout not in (WEEK_FIRST, USER_FIRST):
        raise ValueError(f"unknown layout {layout!r}")
    year_week = F.substring_index(F.col(col), ":", 1 if layout == WEEK_FIRST else -1)
    return df.withColumn(out, F.concat(year_week, F.lit("_"), F.col(county)))
