import random

import pytest
from pyspark.sql import functions as F

from weekpanel.operators import ranking


@pytest.mark.parametrize("size", [0, 1, 5, 1000])
def test_ids_are_one_to_n_in_order(spark, size):
    values = list(range(size))
    random.Random(size).shuffle(values)
    df = spark.createDataFrame([(v % 7, v) for v in values], "a long, b long").repartition(6)
    rows = ranking.number_rows(df, ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(rows, key=lambda r: r["id"])] == sorted((v % 7, v) for v in values)
    assert sorted(r["id"] for r in rows) == list(range(1, size + 1))


def test_nulls_are_numbered_last(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",)], "k string")
    assert {r["k"]: r["id"] for r in ranking.number_rows(df, ["k"], start=0).collect()} == {"a": 0, "b": 1, None: 2}


def test_order_may_descend(spark):
    rows = ranking.number_rows(spark.range(100), [F.col("id").desc()], id_col="n").collect()
    assert all(r["n"] == 100 - r["id"] for r in rows)


@pytest.mark.parametrize("sizes", ["even", "mixed"])
def test_running_start_is_the_exclusive_running_sum(spark, sizes):
    rng = random.Random(1)
    rows = [(f"k{i:04d}", 3 if sizes == "even" else rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(5)
    got = {r["k"]: r["start"] for r in ranking.running_start(df, ["k"], F.col("n")).collect()}
    total, want = 0, {}
    for key, size in rows:
        want[key], total = total, total + size
    assert got == want


@pytest.mark.parametrize("n", [25, 40, 41, 7, 0])
def test_extremes_match_sort_and_slice(spark, n):
    rng = random.Random(n)
    rows = [(f"k{i}", float(rng.randrange(10))) for i in range(n)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, s double").repartition(3)
    ordered = sorted((s, k) for k, s in rows if s is not None)
    middle = n // 2 - 5
    want = {
        "lowest": ordered[:10],
        "middle": ordered[max(0, middle) : max(0, middle + 10)],
        "highest": ordered[-10:] if n else [],
    }
    got = {part: [] for part in want}
    for r in ranking.extremes(df, "s", ["k"]).collect():
        got[r["part"]].append((r["s"], r["k"]))
    assert {p: sorted(v) for p, v in got.items()} == want


def test_sorted_weeks_break_ties_by_key(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "user_year_week string, message_count long")
    assert [r[0] for r in ranking.sort_weeks_by_count(df).collect()] == ["c", "a", "b"]
    assert [r[0] for r in ranking.sample_rows(df, ["user_year_week"], 2).collect()] == ["a", "b"]
