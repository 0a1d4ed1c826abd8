"""The salted join beside the plain one, and its tasks where adaptive splitting is off."""

import pytest
from pyspark.sql import functions as F

from weekpanel.operators import clean, hot_join, rollup


@pytest.fixture(scope="module")
def large(spark):
    """Two keys on a third of the rows each, a null key, and rare ones."""
    return spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN 8 WHEN id % 100 = 2 THEN NULL ELSE id % 500 END AS user_id", "id AS v", "'x' AS _n"
    ).repartition(6)


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(7, "a"), (7, "b"), (None, "n"), (9, "c"), (11, "d"), (10_000, "e")], "user_id long, w string")


@pytest.mark.parametrize("how", hot_join.HOWS)
@pytest.mark.parametrize("share", [0.5, 0.01, 0.001])
def test_the_rows_are_those_of_the_plain_join(large, small, how, share):
    got, plain = hot_join.salted_join(large, small, "user_id", how, share), large.join(small, "user_id", how)
    assert got.columns == plain.columns
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_no_task_gets_a_hot_key_whole(large, small, settings):
    settings(spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="40")
    everyone = small.unionByName(large.sparkSession.createDataFrame([(8, "f")], small.schema))

    def most(joined):
        return joined.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]

    plain, salted = large.join(everyone, "user_id"), hot_join.salted_join(large, everyone, "user_id", share=0.01)
    assert plain.count() == salted.count() >= 30_000
    assert most(plain) >= 20_000
    assert most(salted) <= 3_500


def test_counties_and_weights_by_the_salted_join(spark, large):
    counties = spark.createDataFrame([(7, "01001"), (8, "01003"), (8, "01005")], "user_id long, cnty string")
    got, plain = (clean.attach_county(large, counties, split_hot=s) for s in (True, False))
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    weights = spark.createDataFrame([(7, 0.5)], "user_id long, weight double")
    got, plain = (rollup.attach_weights(large, weights, split_hot=s) for s in (True, False))
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_empty_sides(large, small):
    assert hot_join.salted_join(large.limit(0), small, "user_id").isEmpty()
    assert hot_join.salted_join(large, small.limit(0), "user_id", "left").count() == 30_000
    with pytest.raises(ValueError, match="how"):
        hot_join.salted_join(large, small, "user_id", "full")
