import pytest
from pyspark.sql import functions as F

from weekpanel.operators import activity
from weekpanel.plans import panel

SCHEMA = "user_year_week string, user_id long, message_id long, fips string"


@pytest.fixture
def messages(spark):
    """User 1 has an active and a heavy week, users 2 and 3 an active one, user 4 a quiet one."""
    weeks = [("w1:1", 1, 5, "01001"), ("w2:1", 1, 20, "01001"), ("w1:2", 2, 5, "01003"), ("w1:3", 3, 14, "01003"), ("w1:4", 4, 4, "01005")]
    rows, number = [], 0
    for key, user, size, fips in weeks:
        for _ in range(size):
            number += 1
            rows.append((key, user, number, fips))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


EDGES = {"1-4": (1, 4), "5-14": (5, 14), "15+": (15, None)}


def test_bands_include_both_ends(spark):
    counts = spark.createDataFrame([(n,) for n in (0, 1, 10, 11, 100, 101, 10**12)], "message_count long")
    rows = {r["message_count"]: r["band"] for r in activity.band(counts).collect()}
    assert rows == {0: None, 1: "1-10", 10: "1-10", 11: "11-100", 100: "11-100", 101: "101+", 10**12: "101+"}


def test_totals_per_band(messages):
    banded = activity.band(activity.week_counts(messages), EDGES)
    rows = {r["band"]: (r["user_weeks"], r["messages"]) for r in activity.band_totals(banded).collect()}
    assert rows == {"1-4": (1, 4), "5-14": (3, 24), "15+": (1, 20)}


def test_report_per_band(messages):
    rows = {r["band"]: tuple(r)[1:] for r in panel.band_report(messages, EDGES).collect()}
    assert rows == {"1-4": (1, 4, 1, 1), "5-14": (3, 24, 3, 2), "15+": (1, 20, 1, 1)}


def test_one_heavy_week_removes_all_weeks_of_its_user(messages):
    assert [r["user_id"] for r in activity.superusers(messages, 15).collect()] == [1]
    kept = panel.activity_panel(messages, (5, 14), 15)
    assert {r["user_year_week"] for r in kept.collect()} == {"w1:2", "w1:3"}
    assert kept.columns == messages.columns


def test_heavy_users_may_stay(messages):
    kept = panel.activity_panel(messages, (5, 14), None)
    assert {r["user_year_week"] for r in kept.collect()} == {"w1:1", "w1:2", "w1:3"}
    assert panel.activity_report(messages, (5, 14), None).first()["messages"] == 24


def test_panel_equals_the_chain_of_joins(messages):
    weeks = activity.week_counts(messages).filter(activity.in_band(F.col("message_count"), 5, 14))
    chained = activity.drop_superusers(activity.keep_band(messages, weeks), activity.superusers(messages, 15))
    direct = panel.activity_panel(messages, (5, 14), 15)
    assert sorted(chained.select(*messages.columns).collect()) == sorted(direct.collect())


def test_keys_that_do_not_name_their_user(spark):
    """Bands follow the key, heavy users the user."""
    rows = [("w1", 1, i, "01001") for i in range(3)] + [("w1", 2, 10 + i, "01001") for i in range(4)]
    rows += [("w2", 2, 20 + i, "01001") for i in range(20)] + [(None, 1, 99, "01001")]
    messages = spark.createDataFrame(rows, SCHEMA)
    kept = panel.activity_panel(messages, (5, 14), 15).collect()
    assert {(r["user_year_week"], r["user_id"]) for r in kept} == {("w1", 1)}
    assert len(kept) == 3


def test_statistics_of_the_panel(messages):
    report = panel.activity_report(messages, (5, 14), 15).first().asDict()
    assert report == {"messages": 19, "user_weeks": 2, "users": 2, "counties": 1}
    assert report == activity.panel_stats(panel.activity_panel(messages, (5, 14), 15)).first().asDict()


def test_null_counts_as_one_value(spark):
    df = spark.createDataFrame([("w", 1, 1, None), ("w", 1, 1, None), (None, 2, None, "01001")], SCHEMA)
    assert tuple(activity.panel_stats(df).first()) == (2, 2, 2, 2)


def test_statistics_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert tuple(activity.panel_stats(df).first()) == (0, 0, 0, 0)
    assert tuple(panel.activity_report(df).first()) == (0, 0, 0, 0)


def test_sketched_statistics_are_close(messages):
    exact, sketched = activity.panel_stats(messages).first(), activity.approx_panel_stats(messages).first()
    assert exact.asDict().keys() == sketched.asDict().keys()
    assert all(abs(a - b) <= max(1, 0.1 * a) for a, b in zip(exact, sketched, strict=True))


def test_funnel_applies_conditions_one_after_the_other(spark):
    df = spark.range(10).withColumn("maybe", F.when(F.col("id") > 2, F.lit(True)))
    rows = activity.funnel({"all": (df, {"big": F.col("id") > 1, "known": F.col("maybe")}), "few": df.limit(3)})
    assert {r["stage"]: r["row_count"] for r in rows.collect()} == {"all": 10, "big": 8, "known": 7, "few": 3}


def test_funnel_counts_rows_whatever_their_columns_are_called(spark):
    df = spark.createDataFrame([(5,), (None,)], "copies int")
    assert activity.funnel({"rows": df}).first()["row_count"] == 2
    assert activity.funnel({"rows": df}, {"rows": "copies"}).first()["row_count"] == 5


def test_statistics_of_what_columns_there_are(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (2, None)], "message_id long, user_id long")
    assert activity.panel_stats(df).first().asDict() == {"messages": 2, "users": 2}
    assert activity.panel_stats(df.select("user_id")).first().asDict() == {"users": 2}
