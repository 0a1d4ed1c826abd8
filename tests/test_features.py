import pytest

from weekpanel.operators import features
from weekpanel.plans import feature_export

COUNTIES = "fips string, weighted_embedding array<double>"


def test_surplus_of_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "fips string")
    assert features.surplus_duplicates(df).first()[0] == 4  # rows without a key are all surplus
    assert features.surplus_duplicates(df, null_keys="one").first()[0] == 3
    assert features.surplus_duplicates(df.filter("fips = 'b'")).first()[0] == 0
    assert features.surplus_duplicates(df.limit(0)).first()[0] == 0


def test_counties_have_one_fixed_survivor(spark):
    df = spark.createDataFrame([("1", [2.0]), ("1", [1.0, 9.0]), ("1", None), ("2", None)], COUNTIES).repartition(3)
    assert {r[0]: r[1] for r in features.dedupe_counties(df).collect()} == {"1": [1.0, 9.0], "2": None}


def test_padding(spark):
    df = spark.createDataFrame([("7",), ("1001",), ("01001",), ("1234567",), (None,)], "fips string")
    assert [r[0] for r in features.pad_county(df).collect()] == ["00007", "01001", "01001", "12345", None]
    assert features.pad_county(spark.createDataFrame([(1001,)], "fips int")).first()[0] == "01001"


def test_explode_skips_empty_and_null(spark):
    df = spark.createDataFrame([("a", [5.0, 6.0]), ("b", []), ("c", None)], COUNTIES)
    rows = features.feature_names(features.explode_features(df, "weighted_embedding")).collect()
    assert [tuple(r) for r in rows] == [("a", 0, 5.0, "0me", 5.0), ("a", 1, 6.0, "1me", 6.0)]


def test_set_difference_is_distinct(spark):
    first = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    second = spark.createDataFrame([(2,)], "x int")
    assert sorted(features.set_difference(first, second).collect(), key=str) == [(1,), (None,)]


@pytest.mark.parametrize("width", [3, None])
def test_table_is_numbered_without_gaps(spark, width):
    base = [(f"{c:05d}", [float(c + i) for i in range(width or c % 4)]) for c in range(40, 80)]
    missing = [("7", [1.0] * (width or 2)), ("7", [0.5] * (width or 2)), ("8", []), ("9", None)]
    table = feature_export.county_feature_table(
        spark.createDataFrame(base, COUNTIES).repartition(5), spark.createDataFrame(missing, COUNTIES)
    )
    assert table.columns == ["id", "group_id", "value", "feat", "group_norm"]
    rows = sorted(map(tuple, table.collect()))
    want, counties = [], sorted([*base, ("00007", [0.5] * (width or 2))])
    for code, vector in counties:
        want += [(code, v, f"{i}me", v) for i, v in enumerate(vector)]
    assert rows == [(i + 1, *row) for i, row in enumerate(want)]


def test_a_county_on_both_sides_stays_twice(spark):
    base = spark.createDataFrame([("01001", [1.0, 2.0])], COUNTIES)
    missing = spark.createDataFrame([("1001", [3.0, 4.0])], COUNTIES)
    rows = sorted(map(tuple, feature_export.county_feature_table(base, missing).collect()))
    assert [r[0] for r in rows] == [1, 2, 3, 4]
    assert {r[1] for r in rows} == {"01001"}
    assert {(rows[0][3], rows[1][3]), (rows[2][3], rows[3][3])} == {("0me", "1me")}
    assert sorted(r[2] for r in rows) == [1.0, 2.0, 3.0, 4.0]


def test_copies_without_a_vector_give_way(spark):
    schema = "fips string, weighted_embedding array<double>"
    missing = spark.createDataFrame([("7", []), ("7", [0.5]), ("7", None), ("8", [])], schema)
    table = feature_export.county_feature_table(missing.limit(0), missing).collect()
    assert [(r["group_id"], r["value"]) for r in table] == [("00007", 0.5)]


def test_rows_without_a_key_are_surplus(spark):
    df = spark.createDataFrame([("1",), ("1",), (None,), (None,)], "fips string")
    assert features.surplus_duplicates(df).first()[0] == 3
    assert features.surplus_duplicates(df, null_keys="one").first()[0] == 2
