import math
import random

import pytest
from pyspark.sql import functions as F

from weekpanel.operators import rollup
from weekpanel.plans import county_weeks

SCORES = "user_year_week string, user_id long, fips string, scaled_dep_score double, scaled_anx_score double"
WEIGHTS = "user_id long, weight double"


@pytest.fixture
def scores(spark):
    rng = random.Random(3)
    rows = [
        (f"2019_{w:02d}:{u}", u, f"0100{u % 3}", rng.uniform(0, 5), None if u % 5 == 0 else rng.uniform(0, 5))
        for w in range(1, 4)
        for u in range(20)
    ]
    return spark.createDataFrame(rows, SCORES).repartition(4)


@pytest.fixture
def weights(spark):
    return spark.createDataFrame([(u, 0.5 + u % 4) for u in range(0, 20, 2)] + [(None, 9.0)], WEIGHTS)


def test_weight_join_keeps_all_scores_and_fans_out(spark):
    scores = spark.createDataFrame([(1, 0.0), (2, 0.0), (None, 0.0)], "user_id long, s double")
    weights = spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 4.0)], WEIGHTS)
    rows = sorted(((r["user_id"], r["weight"]) for r in rollup.attach_weights(scores, weights).collect()), key=str)
    assert rows == [(1, 2.0), (1, 3.0), (2, None), (None, None)]


def test_repeated_weights_raise_when_they_must_be_unique(spark):
    scores = spark.createDataFrame([(1, 0.0), (2, 0.0)], "user_id long, s double")
    twice = spark.createDataFrame([(1, 2.0), (1, 3.0)], WEIGHTS)
    with pytest.raises(Exception, match="several weights for user 1"):
        rollup.attach_weights(scores, twice, unique=True).collect()
    once = spark.createDataFrame([(1, 2.0), (3, None)], WEIGHTS)
    rows = {r["user_id"]: r["weight"] for r in rollup.attach_weights(scores, once, unique=True).collect()}
    assert rows == {1: 2.0, 2: None}


def test_defaults_and_fallbacks(spark):
    df = spark.createDataFrame([(None, "01001", None), (2.0, None, "01003"), (None, None, None), (1.0, "a", "b")], "weight double, cnty string, fips string")
    assert [r["weight"] for r in rollup.default_weight(df).collect()] == [1.0, 2.0, 1.0, 1.0]
    assert [r["cnty"] for r in rollup.county_fallback(df).collect()] == ["01001", "01003", None, "a"]
    assert tuple(rollup.county_null_counts(df).first()) == (2, 1)
    assert [r["weight"] for r in rollup.county_mismatch(df).collect()] == [1.0]
    assert rollup.county_mismatch_sample(df.union(df).union(df), ["weight"], 2).count() == 2


def test_melt_equals_two_selects_and_a_union(scores, weights):
    weighted = county_weeks.weighted_scores(scores, weights)
    long = rollup.melt_scores(weighted)
    assert long.columns == ["user_id", "year_week_county", "fips", "user_weight", "feat", "feat_score"]
    one, two = (
        rollup.labelled(weighted.select("user_id", "year_week_county", "fips", "user_weight", F.col(c).alias("feat_score")), f)
        for f, c in (("DEP_SCORE", "scaled_dep_score"), ("ANX_SCORE", "scaled_anx_score"))
    )
    both = rollup.union_targets(one, two).select(*long.columns)
    assert long.exceptAll(both).count() == both.exceptAll(long).count() == 0
    assert long.count() == 120


def close(a, b):
    return (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("null_weights", ["keep", "drop"])
def test_rollup_before_and_after_the_melt(scores, weights, null_weights):
    weighted = county_weeks.weighted_scores(scores, weights)
    long = rollup.county_week_rollup(rollup.melt_scores(weighted), null_weights, True)
    wide = county_weeks.county_week_scores(scores, weights, null_weights=null_weights, weighted_std=True)
    assert sorted(long.columns) == sorted(wide.columns)
    keyed = {(r["year_week_county"], r["feat"]): r for r in wide.collect()}
    rows = long.collect()
    assert len(rows) == len(keyed) == rollup.rollup_group_count(long).first()[0] == 18
    for r in rows:
        other = keyed[r["year_week_county"], r["feat"]]
        assert all(close(r[c], other[c]) for c in ("wavg_score", "avg_score", "std_score", "std_score_wt"))
        assert r["N_users"] == other["N_users"]


LONG = "user_id long, year_week_county string, fips string, user_weight double, feat string, feat_score double"


def test_a_null_score_adds_its_weight_unless_told_otherwise(spark):
    rows = [(1, "w_c", "c", 1.0, "F", 4.0), (2, "w_c", "c", 3.0, "F", None), (2, "w_c", "c", 1.0, "F", 2.0)]
    df = spark.createDataFrame(rows, LONG)
    kept = rollup.county_week_rollup(df).first()
    assert (kept["wavg_score"], kept["avg_score"], kept["std_score"], kept["N_users"]) == (6.0 / 5.0, 3.0, 1.0, 2)
    dropped = rollup.county_week_rollup(df, "drop", weighted_std=True).first()
    assert (dropped["wavg_score"], dropped["std_score_wt"]) == (3.0, 1.0)
    with pytest.raises(ValueError):
        rollup.county_week_rollup(df, "other")


def test_equal_weights_give_the_plain_statistics(scores, spark):
    everyone = spark.createDataFrame([(u, 2.5) for u in range(20)], WEIGHTS)
    for r in county_weeks.county_week_scores(scores, everyone, null_weights="drop", weighted_std=True).collect():
        assert close(r["wavg_score"], r["avg_score"])
        assert r["avg_score"] is None or math.isclose(r["std_score_wt"], r["std_score"], abs_tol=1e-6)


def test_groups_without_weight_are_null(spark):
    df = spark.createDataFrame([(1, "w_c", "c", 0.0, "F", 4.0)], LONG)
    row = rollup.county_week_rollup(df, weighted_std=True).first()
    assert (row["wavg_score"], row["avg_score"], row["std_score_wt"]) == (None, 4.0, None)


def test_weighted_deviation_is_by_definition_with_a_null_score(spark):
    df = spark.createDataFrame(
        [("g", "dep", 1, 2.0, 1.0), ("g", "dep", 2, None, 1.0)],
        "year_week_county string, feat string, user_id long, feat_score double, user_weight double",
    )
    assert rollup.county_week_rollup(df, weighted_std=True).first()["std_score_wt"] == pytest.approx(0.5**0.5)
    assert rollup.county_week_rollup(df, "drop", weighted_std=True).first()["std_score_wt"] == 0


def test_weighted_deviation_of_large_scores_does_not_cancel(spark):
    df = spark.createDataFrame(
        [(None, "dep", 1, 1e8, 1.0), (None, "dep", 2, 1e8 + 1, 1.0)],
        "year_week_county string, feat string, user_id long, feat_score double, user_weight double",
    )
    row = rollup.county_week_rollup(df, weighted_std=True).first()
    assert row["std_score_wt"] == pytest.approx(0.5) == row["std_score"]
