"""What the physical plans must and must not hold, and how hot keys are met."""

import pytest
from pyspark.sql import functions as F

from weekpanel.operators import activity, batches, clean, embed, features, ranking, rollup, score
from weekpanel.plans import cleaning, county_weeks, feature_export, incremental, panel, scoring

MESSAGES = "user_year_week string, message_id long, user_id long, message string, created_at string, location string, coordinates string"


@pytest.fixture
def shuffled_joins(settings):
    """No broadcast, and thresholds that make a few hundred kilobytes count as a hot partition."""
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100kb",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64kb",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )


@pytest.fixture
def skewed(spark):
    """60,000 messages of 2,000 users; a third of them in one week of user 0."""
    hot = F.col("id") % 3 == 0
    user = F.when(hot, F.lit(0)).otherwise(F.col("id") % 2000)
    return spark.range(0, 60_000, 1, 12).select(
        F.concat(F.lit("2019_05:"), user.cast("string")).alias("user_year_week"),
        F.col("id").alias("message_id"),
        user.alias("user_id"),
        F.sha2(F.col("id").cast("string"), 512).alias("message"),
        F.lit("2019-02-01 00:00:00").alias("created_at"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("coordinates"),
    )


@pytest.fixture
def counties(spark):
    return spark.range(2000).select(F.col("id").alias("user_id"), F.lpad((F.col("id") % 99999).cast("string"), 5, "0").alias("cnty"))


def test_a_hot_user_is_split_in_the_county_join(skewed, counties, shuffled_joins, physical_plan):
    located = clean.attach_county(skewed, counties)
    assert "skew=true" in physical_plan(located, run=True)
    assert located.count() == 60_000


def test_a_hot_user_week_is_split_in_the_selection(skewed, shuffled_joins, physical_plan):
    weeks = activity.week_counts(skewed)
    kept = activity.keep_band(skewed, weeks)
    assert "skew=true" in physical_plan(kept, run=True)
    assert kept.count() == 60_000


def test_a_hot_user_week_is_split_among_batch_members(skewed, shuffled_joins, physical_plan):
    assigned = activity.week_counts(skewed).withColumn("batch", F.lit(0).cast("bigint"))
    members = batches.batch_members(skewed, assigned)
    assert "skew=true" in physical_plan(members, run=True)
    assert members.count() == 60_000


def test_a_hot_user_is_split_when_heavy_users_are_dropped(skewed, shuffled_joins, physical_plan):
    users = skewed.filter("user_id BETWEEN 100 AND 300").select("user_id").distinct()
    kept = activity.drop_superusers(skewed, users)
    assert "skew=true" in physical_plan(kept, run=True)
    assert kept.filter("user_id = 0").count() == 20_020


def test_hot_user_weeks_are_split_in_the_panel(skewed, shuffled_joins, physical_plan):
    kept = panel.activity_panel(skewed, (5, 10**9), 10**9 + 1)
    assert "skew=true" in physical_plan(kept, run=True)
    assert kept.count() == 60_000


def test_a_hot_user_is_split_among_weighted_scores(spark, skewed, shuffled_joins, physical_plan):
    scores = skewed.select("user_year_week", "user_id", F.substring("message", 1, 5).alias("fips"), F.rand(1).alias("scaled_dep_score"), F.rand(2).alias("scaled_anx_score"))
    weights = spark.range(0, 2000, 2).select(F.col("id").alias("user_id"), F.lit(2.0).alias("weight"))
    rolled = county_weeks.county_week_scores(scores, weights)
    assert "skew=true" in physical_plan(rolled, run=True)
    assert rolled.agg(F.sum("N_users")).first()[0] > 0


def test_copies_of_one_message_are_cut_before_the_shuffle(spark, counties, physical_plan):
    copies = spark.range(0, 90_000, 1, 12).select(
        F.lit("2019_05:1").alias("user_year_week"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("message_id"),
        F.lit(1).cast("long").alias("user_id"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("message"),
        F.lit("2019-02-01 00:00:00").alias("created_at"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("coordinates"),
    )
    unique = clean.dedupe_messages(copies)
    plan = physical_plan(unique)
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    rows = unique.filter("message_id = 7").collect()
    assert [r["message"] for r in rows] == ["text 0"]
    assert unique.count() == 60_000


def test_counts_are_combined_before_the_shuffle(skewed, physical_plan):
    for df in (activity.week_counts(skewed), batches.batch_summary(skewed.withColumn("batch", F.lit(1)))):
        plan = physical_plan(df)
        assert plan.rindex("partial_count") > plan.index("Exchange")


def test_one_wide_shuffle_for_duplicates_and_earlier_ids(spark, skewed, counties, shuffled_joins, physical_plan):
    """The join with earlier batches reuses the partitioning by message id."""
    cleaned = cleaning.clean_messages(skewed, counties)
    prior = spark.range(100).select(F.col("id").alias("message_id"))
    marked = batches.drop_existing(cleaned, prior)
    plan = physical_plan(marked)
    assert plan.count("Exchange hashpartitioning(message_id") == 1 + 1  # messages once, earlier ids once


def test_messages_are_read_once_for_the_report(skewed, counties, monkeypatch, physical_plan):
    seen = []
    real = activity.stage

    def watch(df, label):
        seen.append((label, physical_plan(df)))
        return real(df, label)

    monkeypatch.setattr(activity, "stage", watch)
    report = panel.activity_report(cleaning.clean_messages(skewed, counties), (5, 100), 101)
    assert [label for label, _ in seen] == ["counts", "totals", "users"]
    assert [plan.count("Range (0, 60000") for _, plan in seen] == [1, 0, 0]
    assert "Range" not in physical_plan(report)


def test_scores_need_neither_shuffle_nor_row_functions(spark, physical_plan):
    embeddings = spark.range(1000).select(
        F.lit("w:1").alias("user_year_week"), F.col("id").alias("user_id"), F.lit("01001").alias("fips"),
        F.array_repeat(F.array_repeat(F.col("id").cast("double"), 300), 4).alias("embedding"),
    )
    zeros = (0.0,) * 300
    model = {"s": score.Model(tuple(f"{i}me" for i in range(300)), zeros, (1.0,) * 300, zeros, 1.0)}
    plan = physical_plan(scoring.raw_scores(embeddings, model, n_layers=4, dim=300))
    assert "Exchange" not in plan
    assert "BatchEvalPython" not in plan
    assert plan.count("ArrowEvalPython") == 1
    narrow = {"s": score.Model(("0me",), (0.0,), (1.0,), (1.0,), 0.0)}
    assert "Python" not in physical_plan(scoring.raw_scores(embeddings, narrow, n_layers=4, dim=300, arrow=False))


def test_ranges_are_no_join(spark, physical_plan):
    plan = physical_plan(score.minmax_scale(spark.range(9).selectExpr("cast(id as double) x"), {"x": "y"}))
    assert "Join" not in plan and "Cartesian" not in plan


def test_numbering_never_gathers_the_rows(spark, monkeypatch, physical_plan):
    seen = []
    real = ranking.stage

    def watch(df, label):
        seen.append(physical_plan(df))
        return real(df, label)

    monkeypatch.setattr(ranking, "stage", watch)
    base = spark.range(100).selectExpr("lpad(cast(id as string), 5, '0') fips", "array_repeat(1.0D, 4) v")
    seen.append(physical_plan(feature_export.county_feature_table(base, base.limit(0), "v")))
    seen.append(physical_plan(batches.assign_batches(base.selectExpr("fips user_year_week", "1L message_count"), 10)))
    seen.append(physical_plan(ranking.number_rows(base, ["fips"])))
    assert len(seen) == 6
    assert not any("SinglePartition" in plan.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS, [plan_id", "") for plan in seen[3:])
    ragged = base.selectExpr("fips", "slice(v, 1, cast(fips as int) % 3 + 1) v")
    plan = physical_plan(features.numbered_features(ragged, "v"))
    assert "SinglePartition" not in plan


def test_group_means_are_combined_before_the_shuffle(spark, physical_plan):
    df = spark.range(100).selectExpr("id % 3 k", "array(1.0D, 2.0D) embedding")
    plan = physical_plan(embed.mean_embedding(df, ["k"]))
    assert plan.index("Exchange") < plan.index("partial_aggregate_metrics")
    assert "Generate" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path, physical_plan):
    path = str(tmp_path / "messages")
    spark.range(10).selectExpr(
        "id message_id", "id user_id", "'x' message", "timestamp'2021-01-01' created_at", "'l' location", "'c' coordinates", "'w' user_year_week", "'01001' fips"
    ).write.parquet(path)
    from weekpanel.operators import calendar

    stored = spark.read.parquet(path)
    plan = physical_plan(activity.week_counts(calendar.in_year(stored, 2021)))
    assert "GreaterThanOrEqual(created_at" in plan and "LessThan(created_at" in plan
    assert "location" not in plan.split("ReadSchema")[1]
    counted = physical_plan(activity.week_counts(stored))
    assert "message_id:bigint" in counted and "message:string" not in counted


def test_rollup_spreads_a_hot_county_week(spark, physical_plan):
    df = spark.range(100).selectExpr(
        "id user_id", "cast(id % 2 as string) year_week_county", "'01001' fips", "1.0D user_weight", "cast(id % 3 as string) feat", "1.0D feat_score"
    )
    spread = df.repartition(4)  # a bare range would count as partitioned by user already
    first, second = physical_plan(rollup.county_week_rollup(spread)).split("Exchange hashpartitioning(")[1:]
    assert "user_id" not in first.split(")")[0]
    assert second.split(")")[0].count(",") == 3  # group, feature, user, number of partitions


def test_new_batches_are_given_out_by_one_join(spark, skewed, counties, monkeypatch, physical_plan):
    seen = {}
    real = incremental.stage

    def watch(df, label):
        seen[label] = physical_plan(df)
        return real(df, label)

    monkeypatch.setattr(incremental, "stage", watch)
    cleaned = cleaning.clean_messages(skewed, counties)
    prior = cleaned.filter("message_id < 100").withColumn("batch", F.lit(3).cast("bigint"))
    members = incremental.incremental_batches(cleaned, prior, active=(5, 100), super_from=101, limit=1000)
    assert "marked" in seen
    assert members.agg(F.min("batch")).first()[0] == 4
    assert members.filter("user_id = 0 OR message_id < 100").count() == 0
