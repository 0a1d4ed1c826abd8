import datetime as dt

import pytest
from pyspark.sql import functions as F

from weekpanel.operators import clean
from weekpanel.plans import cleaning


def texts(df):
    return [r["message"] for r in df.collect()]


@pytest.fixture
def frame(spark):
    return lambda *messages: spark.createDataFrame([(m,) for m in messages], "message string")


def test_mask_hits_mentions_and_mail_domains(frame):
    masked = clean.mask_mentions(frame("hi @Bob_1!", "mail a@b.com", "@a@b", None, "no @ here"))
    assert texts(masked) == ["hi <USER>!", "mail a<USER>.com", "<USER><USER>", None, "no @ here"]


def test_retweets_are_dropped_by_case_and_place(frame):
    kept = clean.drop_retweets(frame("RT @bob: hi", "rt @bob: hi", "x RT @bob: hi", "RT @bob hi", "RT <USER>: hi", None))
    assert texts(kept) == ["rt @bob: hi", "x RT @bob: hi", "RT @bob hi", "RT <USER>: hi"]


def test_urls_need_one_character_after_the_scheme(frame):
    kept = clean.drop_urls(frame("see http://x.y", "https://a", "https://", "x http://~", "http://%41", "http:// a", "HTTP://a", None))
    assert texts(kept) == ["https://", "x http://~", "http:// a", "HTTP://a"]


def test_long_urls_do_not_overflow_the_stack(frame):
    long_url = "go http://" + "a" * 300_000 + " end"
    assert clean.drop_urls(frame(long_url, "stay " * 100_000)).count() == 1


def test_county_filters_and_null_make_up_all_rows(spark):
    codes = [None, "1001", "01001", "012345", "", "n/a", "0100a", "7", " 01001"]
    df = spark.createDataFrame([(c,) for c in codes], "fips string")
    valid = [r[0] for r in clean.county_valid(df).collect()]
    invalid = [r[0] for r in clean.county_invalid(df).collect()]
    assert valid == ["01001"]
    assert sorted(valid + invalid) == sorted(c for c in codes if c is not None)
    assert [r[0] for r in clean.county_short(df).collect()] == ["1001", "7"]


def test_numeric_codes_are_judged_as_text(spark):
    df = spark.createDataFrame([(1001,), (12345,)], "fips int")
    assert [r[0] for r in clean.county_invalid(df).collect()] == [1001]


def test_times_that_are_none_become_null(spark):
    df = spark.createDataFrame([("2021-01-01 10:00:00",), ("junk",), (None,), ("2021-13-01",)], "created_at string")
    assert [r[0] for r in clean.parse_created_at(df).collect()] == [dt.datetime(2021, 1, 1, 10), None, None, None]


def test_county_join_drops_unmapped_users_and_fans_out(spark):
    messages = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "user_id long, message string")
    counties = spark.createDataFrame([(1, "01001"), (1, "01003"), (None, "01005")], "user_id long, cnty string")
    rows = sorted((r["message"], r["fips"]) for r in clean.attach_county(messages, counties).collect())
    assert rows == [("a", "01001"), ("a", "01003")]


def test_duplicates_have_one_fixed_survivor(spark):
    early, late = dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 2)
    rows = [(1, late, 5, "01001", "z"), (1, early, 6, "01003", "b"), (1, early, 6, "01003", "a"), (1, early, 7, "01001", "a"), (2, None, 1, None, "n")]
    df = spark.createDataFrame(rows, "message_id long, created_at timestamp, user_id long, fips string, message string")
    for shuffled in (df, df.orderBy(F.desc("message")), df.repartition(5)):
        kept = {r["message_id"]: (r["user_id"], r["message"]) for r in clean.dedupe_messages(shuffled).collect()}
        assert kept == {1: (6, "a"), 2: (1, "n")}


def test_null_times_lose_against_any_time(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, dt.datetime(2021, 1, 1), "b")], "message_id long, created_at timestamp, message string")
    assert clean.dedupe_messages(df).first()["message"] == "b"


MESSAGES = "message_id long, user_id long, message string, created_at string, location string, coordinates string"


@pytest.fixture
def small(spark):
    time = "2021-03-01 00:00:00"
    messages = spark.createDataFrame(
        [
            (1, 1, "RT @bob: hi", time, None, None),
            (2, 1, "hi @bob", time, "x", None),
            (3, 1, "http://a.b", time, None, None),
            (4, None, "no user", time, None, None),
            (5, 2, "short county", time, None, None),
            (6, 1, "last year", "2020-12-31 00:00:00", None, None),
            (7, 1, "bad time", "junk", None, None),
            (None, 1, "no id", time, None, None),
            (9, 1, "no time", None, None, None),
        ],
        MESSAGES,
    )
    counties = spark.createDataFrame([(1, "01001"), (2, "1001")], "user_id long, cnty string")
    return messages, counties


def ids(df):
    return sorted(r["message_id"] for r in df.collect())


def test_order_of_mask_and_filter_decides_on_retweets(small):
    assert ids(cleaning.clean_messages(*small, year=2021)) == [2]
    assert ids(cleaning.clean_messages(*small, year=2021, order="mask_first")) == [1, 2]


def test_without_a_year_all_years_and_unparsed_times_stay(small):
    cleaned = cleaning.clean_messages(*small)
    assert ids(cleaned) == [2, 6, 7]
    keys = {r["message_id"]: r["user_year_week"] for r in cleaned.collect()}
    assert keys == {2: "1:2021-9", 6: "1:2020-53", 7: None}


def test_invalid_counties_and_no_county_filter(small):
    assert ids(cleaning.clean_messages(*small, county="invalid")) == [5]
    assert ids(cleaning.clean_messages(*small, county=None)) == [2, 5, 6, 7]


def test_ready_made_keys_are_kept(small):
    messages, counties = small
    keyed = messages.withColumn("user_year_week", F.lit("2019_05:42"))
    assert {r["user_year_week"] for r in cleaning.clean_messages(keyed, counties).collect()} == {"2019_05:42"}


def test_county_is_judged_after_the_duplicates(spark):
    messages = spark.createDataFrame([(1, 1, "a", "2021-03-01 00:00:00", None, None)], MESSAGES)
    counties = spark.createDataFrame([(1, "01001"), (1, "0")], "user_id long, cnty string")
    assert cleaning.clean_messages(messages, counties).count() == 0
    assert cleaning.clean_messages(messages, counties, county="invalid").count() == 1


def test_unknown_order_is_refused(small):
    with pytest.raises(ValueError, match="order"):
        cleaning.clean_messages(*small, order="any")


def test_funnel_counts_every_step(small):
    rows = {r["stage"]: r["row_count"] for r in cleaning.cleaning_funnel(*small).collect()}
    assert rows == {
        "read": 9,
        "keyed": 6,
        "located": 6,
        "without_retweets": 5,
        "without_urls": 4,
        "unique": 4,
        "county_valid": 3,
    }


def test_match_counts_of_one_year(small):
    rows = {r["stage"]: r["row_count"] for r in cleaning.county_match_counts(*small, 2021).collect()}
    assert rows == {"in_year": 4, "matched": 4}


def test_reduced_map_keeps_the_same_survivors(spark):
    """Joining all counties and removing duplicates gives what joining the reduced map gives."""
    messages = spark.createDataFrame(
        [(i % 40, i % 7, f"m{i}", f"2021-03-0{1 + i % 3} 00:00:00", None, None) for i in range(120)], MESSAGES
    )
    codes = [None, "01003", "01001", "9", "x", "01005"]
    counties = spark.createDataFrame([(u, codes[(u * 3 + j) % 6]) for u in range(6) for j in range(4)] + [(6, None)], "user_id long, cnty string")
    fanned = clean.dedupe_messages(cleaning.located_messages(messages, counties))
    reduced = cleaning.clean_messages(messages, counties, county=None)
    assert sorted(map(str, fanned.collect())) == sorted(map(str, reduced.collect()))
    assert cleaning.located_messages(messages, counties).count() > 120


def test_funnel_counts_copies_without_building_them(small, spark):
    messages, _ = small
    counties = spark.createDataFrame([(1, "01001"), (1, "01003"), (1, None), (2, "1001"), (None, "x")], "user_id long, cnty string")
    rows = {r["stage"]: r["row_count"] for r in cleaning.cleaning_funnel(messages, counties).collect()}
    assert rows["located"] == 3 * 5 + 1 == clean.attach_county(clean.require_keys(messages), counties).count()
    assert (rows["without_urls"], rows["unique"]) == (3 * 3 + 1, 4)
