import math

import pytest
from pyspark.sql import functions as F

from weekpanel.operators import embed

LAYERS = "id long, embedding array<array<double>>"


def test_shape_check_survives_empty_and_null(spark):
    rows = [(1, [[1.0, 2.0]] * 4), (2, [[1.0, 2.0]] * 3), (3, [[1.0]] * 4), (4, []), (5, None), (6, [None] * 4), (7, [[], [], [], []])]
    df = spark.createDataFrame(rows, LAYERS)
    assert [r["id"] for r in embed.valid_layers(df, 4, 2).collect()] == [1]


def test_only_the_second_last_layer_is_picked(spark):
    rows = [(1, [[1.0], [2.0], [3.0], [4.0]]), (2, [[1.0], [2.0]]), (3, [[1.0]]), (4, []), (5, None)]
    df = embed.flatten_layers(embed.pick_layer(spark.createDataFrame(rows, LAYERS)))
    assert {r["id"]: r["vector"] for r in df.collect()} == {1: [3.0], 2: [1.0], 3: [], 4: [], 5: None}
    assert {r["id"]: r["layers"] for r in df.collect()} == {1: [[3.0]], 2: [[1.0]], 3: [], 4: [], 5: None}


def test_years_are_matched_by_name(spark):
    first = spark.createDataFrame([(1, "a")], "x long, y string")
    second = spark.createDataFrame([("b", 2)], "y string, x long")
    assert sorted(map(tuple, embed.union_years(first, second, first).collect())) == [(1, "a"), (1, "a"), (2, "b")]


def test_means_and_counts(spark):
    rows = [("a", [1.0, 2.0], 1.0), ("a", [3.0, 6.0], 3.0), ("b", [5.0, 5.0], 2.0), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, embedding array<double>, w double").repartition(3)
    means = {r["k"]: (r["embedding"], r["message_count"]) for r in embed.mean_embedding(df, ["k"]).collect()}
    assert means == {"a": ([2.0, 4.0], 2), "b": ([5.0, 5.0], 1)}
    weighted = {r["k"]: r["weighted_embedding"] for r in embed.weighted_mean_embedding(df, ["k"], "w").collect()}
    assert weighted == {"a": [2.5, 5.0], "b": [5.0, 5.0]}


def test_rows_without_weight_do_not_count(spark):
    rows = [("a", [1.0], 0.0), ("a", [3.0], None), ("a", [5.0], 2.0)]
    df = spark.createDataFrame(rows, "k string, embedding array<double>, w double")
    row = embed.weighted_mean_embedding(df, ["k"], "w").first()
    assert (row["weighted_embedding"], row["message_count"]) == ([5.0], 1)


def test_layered_means_keep_their_layers(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0]]), (1, [[3.0, 4.0], [5.0, 6.0]])]
    row = embed.mean_embedding(spark.createDataFrame(rows, LAYERS), ["id"], layered=True).first()
    assert row["embedding"] == [[2.0, 3.0], [4.0, 5.0]]


def test_means_equal_the_exploded_average(spark):
    df = spark.range(3000).select(
        (F.col("id") % 37).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("embedding")
    )
    exploded = df.select("k", F.posexplode("embedding")).groupBy("k", "pos").agg(F.avg("col").alias("v"))
    want = {(r["k"], r["pos"]): r["v"] for r in exploded.collect()}
    got = embed.mean_embedding(df, ["k"]).select("k", F.posexplode("embedding"))
    assert all(math.isclose(r["col"], want[r["k"], r["pos"]], rel_tol=1e-9, abs_tol=1e-12) for r in got.collect())
    assert got.count() == len(want)


def test_unequal_lengths_in_a_group_are_an_error(spark):
    df = spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "k string, embedding array<double>")
    with pytest.raises(Exception, match="[Dd]imension"):
        embed.mean_embedding(df, ["k"]).collect()
