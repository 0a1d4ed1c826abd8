import random

import pytest
from pyspark.sql import functions as F

from weekpanel.functions import vectors
from weekpanel.operators import score

VECTORS = "id long, vector array<double>"


def model(width=6, seed=0, names=None):
    rng = random.Random(seed)
    features = tuple(names or (f"{i}me" for i in rng.sample(range(width), width)))
    numbers = [tuple(rng.uniform(-1, 1) for _ in features) for _ in range(3)]
    return score.Model(features, numbers[0], tuple(abs(s) + 0.1 for s in numbers[1]), numbers[2], 2.5)


@pytest.fixture
def frame(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(50)]
    rows += [(100, [1.0, 2.0]), (101, []), (102, None), (103, [1.0] * 9), (104, [None, 1.0, None, 2.0, 3.0, 4.0])]
    return spark.createDataFrame(rows, VECTORS)


@pytest.mark.parametrize(("name", "index"), [("0me", 0), ("17me", 17), ("me", -1), ("07me", -1), ("-1me", -1), ("3", -1), ("3me3", -1), ("٣me", -1)])
def test_feature_names(name, index):
    assert vectors.source_index(name) == index


def test_alignment_puts_components_by_name(spark):
    df = spark.createDataFrame([(1, [10.0, 20.0, 30.0]), (2, None), (3, [])], VECTORS)
    rows = score.align_features(df, ["2me", "0me", "9me", "other", "2me"]).collect()
    assert [r["aligned"] for r in rows] == [[30.0, 10.0, 0.0, 0.0, 30.0], None, [0.0] * 5]


def test_standardising_leaves_zero_scale_undivided(spark):
    df = spark.createDataFrame([([4.0, 4.0],)], "aligned array<double>")
    assert score.standardise(df, [2.0, 1.0], [4.0, 0.0]).first()["standardised"] == [0.5, 3.0]


def chained(df, fitted):
    aligned = score.align_features(df, fitted.features)
    standardised = score.standardise(aligned, fitted.mean, fitted.scale)
    return {r["id"]: r["score"] for r in score.ridge_score(standardised, fitted.coef, fitted.intercept).collect()}


@pytest.mark.parametrize("names", [None, ["5me", "9me", "x", "0me", "0me"], ["x"]])
@pytest.mark.parametrize("arrow", [False, True])
def test_folded_score_equals_the_chain(frame, names, arrow):
    models = {"one": model(names=names), "two": model(seed=4)}
    scored = {r["id"]: r for r in score.fused_scores(frame, models, arrow=arrow).collect()}
    for target, fitted in models.items():
        want = chained(frame, fitted)
        for i, value in want.items():
            assert (scored[i][target] is None) if value is None else scored[i][target] == pytest.approx(value, abs=1e-9)


def test_arrow_scores_many_partitions_and_empty_input(spark):
    fitted = {"s": model(width=300)}
    df = spark.range(2000).select("id", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.cos(F.col("id") + i)).alias("vector"))
    native = {r["id"]: r["s"] for r in score.fused_scores(df, fitted, arrow=False).collect()}
    scored = {r["id"]: r["s"] for r in score.fused_scores(df.repartition(7), fitted).collect()}
    assert scored.keys() == native.keys()
    assert all(scored[i] == pytest.approx(native[i], abs=1e-9) for i in native)
    assert score.fused_scores(df.filter("id < 0"), fitted).count() == 0


def test_single_precision_is_an_option(spark):
    df = spark.createDataFrame([(1, [0.1])], VECTORS)
    fitted = {"s": score.Model(("0me",), (0.0,), (1.0,), (1.0,), 0.2)}
    assert dict(score.fused_scores(df, fitted, as_float=True).dtypes)["s"] == "float"
    assert dict(score.fused_scores(df, fitted).dtypes)["s"] == "double"


def test_rescaling_to_the_range(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (5.0, 7.0), (None, None)], "a double, b double")
    rows = score.minmax_scale(df, {"a": "x", "b": "y"}).collect()
    assert [r["x"] for r in rows] == [0.0, 1.25, 5.0, None]
    assert [r["y"] for r in rows] == [None] * 4
    assert [r["x"] for r in score.minmax_scale(df, {"a": "x"}, -1.0, 1.0).collect()] == [-1.0, -0.5, 1.0, None]


def test_ranges_of_all_scores_in_one_row(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 9.0)], "a double, b double")
    assert score.global_min_max(df, ["a", "b"]).first().asDict() == {"min_a": 1.0, "max_a": 2.0, "min_b": 7.0, "max_b": 9.0}


def test_repeated_keys_multiply_in_the_join_of_targets(spark):
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.0)], "user_year_week string, x double")
    two = spark.createDataFrame([("a", 5.0), ("a", 6.0), ("b", 7.0)], "user_year_week string, y double")
    rows = sorted(map(tuple, score.combine_targets(one, two, "y").collect()))
    assert rows == [("a", 1.0, 5.0), ("a", 1.0, 6.0), ("b", 2.0, 7.0)]


def test_models_are_read_by_target_and_place(spark):
    rows = [("b", 0, "0me", 0.0, 1.0, 1.0, 3.0), ("a", 1, "0me", 0.5, 2.0, 3.0, 1.5), ("a", 0, "1me", 0.25, 4.0, 5.0, 1.5)]
    models = score.collect_models(spark.createDataFrame(rows, "target string, pos int, feature string, mean double, scale double, coef double, intercept double"))
    assert models["a"] == score.Model(("1me", "0me"), (0.25, 0.5), (4.0, 2.0), (5.0, 3.0), 1.5)
    assert models["b"].intercept == 3.0


def test_constants_must_be_finite():
    with pytest.raises(ValueError, match="finite"):
        vectors.double_array([float("nan")])
