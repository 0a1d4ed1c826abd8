import datetime as dt

import pytest

from weekpanel.operators import calendar


@pytest.fixture
def times(spark):
    days = [dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 4), dt.datetime(2020, 12, 31, 23, 59), dt.datetime(2021, 12, 31), None]
    return spark.createDataFrame([(42, d) for d in days], "user_id long, created_at timestamp")


def test_calendar_year_beside_iso_week(times):
    rows = [(r["year"], r["week"]) for r in calendar.calendar_parts(times).collect()]
    assert rows == [(2021, 53), (2021, 1), (2020, 53), (2021, 52), (None, None)]


def test_iso_year(times):
    rows = [(r["year"], r["week"]) for r in calendar.calendar_parts(times, "iso").collect()]
    assert rows == [(2020, 53), (2021, 1), (2020, 53), (2021, 52), (None, None)]


def test_in_year_is_half_open(times):
    assert calendar.in_year(times, 2021).count() == 3
    assert calendar.in_year(times, 2020).count() == 1


def test_keys_of_both_layouts(times):
    parts = calendar.calendar_parts(times)
    first = [r["user_year_week"] for r in calendar.build_key(parts).collect()]
    assert first == ["42:2021-53", "42:2021-1", "42:2020-53", "42:2021-52", None]
    week = [r["user_year_week"] for r in calendar.build_key(parts, calendar.WEEK_FIRST).collect()]
    assert week == ["2021_53:42", "2021_01:42", "2020_53:42", "2021_52:42", None]


@pytest.mark.parametrize(
    ("layout", "keys", "parts"),
    [
        (calendar.USER_FIRST, ["42:2021-5", "abc", None, "x:2021-5"], [(42, 2021, 5), (None,) * 3, (None,) * 3, (None,) * 3]),
        (calendar.WEEK_FIRST, ["2019_05:42", "abc", None], [(42, 2019, 5), (None,) * 3, (None,) * 3]),
    ],
)
def test_split(spark, layout, keys, parts):
    df = spark.createDataFrame([(k,) for k in keys], "user_year_week string")
    rows = calendar.split_key(df, layout).collect()
    assert [(r["key_user"], r["key_year"], r["key_week"]) for r in rows] == parts


def test_county_week_key(spark):
    rows = [("2019_05:42", "01001"), ("abc", "01001"), (None, "01001"), ("2019_05:42", None), ("42:2021-5", "01001")]
    df = calendar.county_week_key(spark.createDataFrame(rows, "user_year_week string, fips string"))
    assert [r[2] for r in df.collect()] == ["2019_05_01001", "abc_01001", None, None, "42_01001"]


def test_county_week_of_keys_with_the_user_first(spark):
    df = spark.createDataFrame([("42:2021-5", "01001"), (None, "01001")], "user_year_week string, fips string")
    assert [r[2] for r in calendar.county_week_key(df, layout=calendar.USER_FIRST).collect()] == ["2021-5_01001", None]
    with pytest.raises(ValueError):
        calendar.county_week_key(df, layout="other")


def test_unknown_options_are_refused(times):
    with pytest.raises(ValueError):
        calendar.calendar_parts(times, "fiscal")
    with pytest.raises(ValueError):
        calendar.build_key(calendar.calendar_parts(times), "other")
    with pytest.raises(ValueError):
        calendar.split_key(times, "other")
