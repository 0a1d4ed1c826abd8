"""The composite jobs on the given tables and in repeated runs."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from checks.adapters import ACTIVE, DIM, N_LAYERS, SUPER_FROM, Inputs
from weekpanel.operators import activity, ranking, rollup
from weekpanel.plans import cleaning, county_weeks, incremental, panel, scoring
from weekpanel.session import stage
from weekpanel.sources import readers

TABLES = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the given tables are not here")


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, TABLES)


@pytest.fixture(scope="module")
def cleaned(inputs):
    return stage(inputs.cleaned(), "cleaned")


def test_known_counts_of_cleaning_and_activity(inputs, cleaned):
    funnel = {r["stage"]: r["row_count"] for r in cleaning.cleaning_funnel(inputs.messages_keyed, inputs.user_county).collect()}
    assert (funnel["read"], funnel["without_urls"], funnel["unique"], funnel["county_valid"]) == (10_000, 6_641, 6_204, 5_403)
    counts = activity.week_counts(cleaned)
    assert counts.filter(activity.in_band(F.col("message_count"), *ACTIVE)).count() == 422
    assert activity.superusers(cleaned, SUPER_FROM).count() == 49
    report = panel.activity_report(cleaned, ACTIVE, SUPER_FROM).first()
    assert (report["messages"], report["users"], report["counties"]) == (2_733, 68, 24)


def test_known_sum_of_scores(inputs):
    raw = scoring.raw_scores(inputs.user_weeks, inputs.models, n_layers=N_LAYERS, dim=DIM)
    row = raw.agg(F.count("*").alias("n"), F.sum("dep_score").alias("s")).first()
    assert row["n"] == 480
    assert math.isclose(row["s"], 1198.867355, abs_tol=1e-5)


def test_a_second_run_adds_nothing(spark, cleaned, tmp_path):
    path, options = str(tmp_path / "batches"), {"active": ACTIVE, "super_from": SUPER_FROM, "limit": 500}
    first = incremental.write_increment(cleaned, path, **options)
    written = {r["batch"]: r["messages"] for r in first.collect()}
    assert sum(written.values()) == 2_733
    assert all(n <= 500 for n in written.values())
    assert sorted(written) == list(range(len(written)))
    assert incremental.write_increment(cleaned, path, **options).count() == 0
    assert readers.read_batches(spark, path).count() == 2_733


def test_later_deliveries_continue_the_numbers(spark, cleaned, tmp_path):
    path, options = str(tmp_path / "batches"), {"active": ACTIVE, "super_from": SUPER_FROM, "limit": 500}
    early = cleaned.filter(F.col("created_at") < F.lit(dt.datetime(2024, 1, 15)))
    incremental.write_increment(early, path, **options)
    before = readers.read_batches(spark, path)
    old = {r["message_id"] for r in before.collect()}
    last = before.agg(F.max("batch")).first()[0]
    added = {r["batch"] for r in incremental.write_increment(cleaned, path, **options).collect()}
    assert min(added) == last + 1
    everything = readers.read_batches(spark, path)
    assert everything.count() == everything.select("message_id").distinct().count()
    wanted = panel.activity_panel(cleaned, ACTIVE, SUPER_FROM, staged=True)
    new = everything.filter(F.col("batch") > last)
    assert {r["message_id"] for r in new.collect()} == {r["message_id"] for r in wanted.collect()} - old


def test_batch_cap_leaves_the_rest_to_the_next_run(spark, cleaned, tmp_path):
    path, options = str(tmp_path / "batches"), {"active": ACTIVE, "super_from": SUPER_FROM, "limit": 500}
    runs = 0
    while incremental.write_increment(cleaned, path, max_batches=2, **options).count():
        runs += 1
    assert runs == 3
    everything = readers.read_batches(spark, path)
    assert everything.count() == everything.select("message_id").distinct().count() == 2_733


def test_equal_scores_rescale_to_null(spark, inputs):
    same = inputs.user_weeks.withColumn("embedding", F.transform("embedding", lambda l: F.transform(l, lambda x: F.lit(1.0))))
    rows = scoring.score_user_weeks(same, inputs.models, n_layers=N_LAYERS, dim=DIM)
    assert rows.count() == 480
    assert rows.filter("dep_score IS NOT NULL AND scaled_dep_score IS NULL").count() == 480


def test_scores_flow_into_county_weeks(inputs):
    scores = scoring.score_user_weeks(inputs.user_weeks, inputs.models, n_layers=N_LAYERS, dim=DIM)
    single = inputs.user_weights.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.max("weight").alias("weight"))
    rolled = county_weeks.county_week_scores(scores, single, unique=True)
    assert rolled.columns == ["year_week_county", "feat", "wavg_score", "avg_score", "std_score", "N_users"]
    assert rolled.agg(F.sum("N_users")).first()[0] == 960


def test_users_with_two_weights_are_refused_where_one_is_asked_for(inputs):
    scores = scoring.score_user_weeks(inputs.user_weeks, inputs.models, n_layers=N_LAYERS, dim=DIM)
    with pytest.raises(Exception, match="several weights for user"):
        county_weeks.county_week_scores(scores, inputs.user_weights, unique=True).collect()


def test_before_and_after_heavy_users(spark, cleaned):
    got = {r["heavy_users"]: tuple(r)[1:] for r in panel.before_after_report(cleaned, ACTIVE, SUPER_FROM).collect()}
    after = tuple(panel.activity_report(cleaned, ACTIVE, SUPER_FROM).first())
    before = tuple(panel.activity_report(cleaned, ACTIVE, None).first())
    assert got == {"kept": before, "removed": after} and before > after
    nobody = panel.before_after_report(cleaned.limit(0), ACTIVE, SUPER_FROM).collect()
    assert {tuple(r) for r in nobody} == {("kept", 0, 0, 0, 0), ("removed", 0, 0, 0, 0)}
    all_heavy = {r["heavy_users"]: r["messages"] for r in panel.before_after_report(cleaned, ACTIVE, 1).collect()}
    assert all_heavy == {"kept": before[0], "removed": 0}


def test_the_funnel_reads_the_messages_once(spark, physical_plan):
    messages = spark.range(1000).selectExpr(
        "id % 300 message_id", "id % 7 user_id", "IF(id % 5 = 0, 'RT @a: x', IF(id % 11 = 0, NULL, 'x')) message",
        "CAST(id % 13 AS STRING) created_at",
    )
    counties = spark.createDataFrame([(1, "01001"), (1, "01003"), (2, "bad"), (3, None), (None, "01005")], "user_id long, cnty string")
    funnel = cleaning.cleaning_funnel(messages, counties)
    assert physical_plan(funnel).count("Range (0, 1000") == 1
    keyed = messages.withColumn("user_year_week", F.lit("k")).withColumn("location", F.lit("")).withColumn("coordinates", F.lit(""))
    got = {r["stage"]: r["row_count"] for r in funnel.collect()}
    located = cleaning.located_messages(keyed, counties)
    assert got["without_urls"] == located.count()
    assert got["unique"] == cleaning.clean_messages(keyed, counties, county=None).count()
    assert got["county_valid"] == cleaning.clean_messages(keyed, counties).count()
    invalid = {r["stage"]: r["row_count"] for r in cleaning.cleaning_funnel(messages, counties, county="invalid").collect()}
    assert invalid["county_invalid"] == cleaning.clean_messages(keyed, counties, county="invalid").count()
    nothing = cleaning.cleaning_funnel(messages.limit(0), counties).collect()
    assert [r["row_count"] for r in nothing] == [0] * 7


def test_weighted_rollup_takes_one_pass(inputs, physical_plan):
    scores = scoring.score_user_weeks(inputs.user_weeks, inputs.models, n_layers=N_LAYERS, dim=DIM)
    weighted = stage(county_weeks.weighted_scores(scores, inputs.user_weights), "weighted")
    plan = physical_plan(rollup.county_week_rollup_wide(weighted, weighted_std=True))
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_extremes_do_not_order_the_whole_table(spark, monkeypatch):
    """Of 200,000 rows some hundreds lie around the middle."""
    ordered = []
    real = ranking.number_rows
    monkeypatch.setattr(ranking, "number_rows", lambda df, *a, **b: (ordered.append(df.count()), real(df, *a, **b))[1])
    rows = spark.range(200_000).selectExpr("id k", "CAST(hash(id) AS DOUBLE) s")
    got = ranking.extremes(rows, "s", ["k"])
    values = sorted((r["s"], r["k"]) for r in rows.collect())
    want = {"lowest": values[:10], "middle": values[99_995:100_005], "highest": values[-10:]}
    assert {p: sorted((r["s"], r["k"]) for r in got.filter(F.col("part") == p).collect()) for p in want} == want
    assert len(ordered) == 1 and ordered[0] < 1_000


def test_a_running_total_takes_one_shuffle(spark, monkeypatch):
    staged = []
    real = ranking.stage
    monkeypatch.setattr(ranking, "stage", lambda df, label: (staged.append(df), real(df, label))[1])
    got = ranking.running_start(spark.range(50_000).selectExpr("id", "id % 7 n"), ["id"], F.col("n"))
    assert len(staged) == 1
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (staged[0], got)]
    assert plans[0].count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plans[0] + plans[1]
    assert got.filter("id = 49999").first()["start"] == sum(k % 7 for k in range(49_999))
