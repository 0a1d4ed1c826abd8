"""The store of deliveries: runs that break off, the index of ids, statistics of any set of batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from checks.adapters import ACTIVE, SUPER_FROM, Inputs
from weekpanel.operators import activity, batches, membership, sketches
from weekpanel.plans import incremental, panel
from weekpanel.session import stage
from weekpanel.sources import writers
from weekpanel.sources.deliveries import Deliveries

TABLES = "/root/testdata/sf0.01"
OPTIONS = {"active": ACTIVE, "super_from": SUPER_FROM, "limit": 500}
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the given tables are not here")


@pytest.fixture(scope="module")
def cleaned(spark):
    return stage(Inputs(spark, TABLES).cleaned(), "cleaned")


@pytest.fixture(scope="module")
def expected(cleaned):
    return {r["message_id"] for r in panel.activity_panel(cleaned, ACTIVE, SUPER_FROM, staged=True).collect()}


def ids_of(store):
    rows = [r["message_id"] for r in store.messages().select("message_id").collect()]
    assert len(rows) == len(set(rows)), "a message was delivered twice"
    return set(rows)


def broken_run(store, cleaned, monkeypatch, at):
    """A delivery that breaks off when it calls ``at``."""

    def fail(*args, **kwargs):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patch:
        patch.setattr(*at, fail)
        with pytest.raises(RuntimeError, match="executor lost"):
            incremental.deliver(cleaned, store.path, **OPTIONS)


@needs_tables
@pytest.mark.parametrize("at", [(membership, "index_ids"), (sketches, "county_bitmaps"), (Deliveries, "_commit")])
def test_a_run_that_breaks_off_loses_and_repeats_nothing(spark, cleaned, expected, tmp_path, monkeypatch, at):
    store = Deliveries(spark, str(tmp_path / "store"))
    early = cleaned.filter(F.col("created_at") < F.lit("2024-01-15").cast("timestamp"))
    incremental.deliver(early, store.path, **OPTIONS)
    before, summary = ids_of(store), sorted(map(tuple, store.summary().collect()))
    broken_run(store, cleaned, monkeypatch, at)
    assert ids_of(store) == before and sorted(map(tuple, store.summary().collect())) == summary
    assert len(store.abandoned()) == 1
    added = {r["batch"]: r["messages"] for r in incremental.deliver(cleaned, store.path, **OPTIONS).collect()}
    assert min(added) == max(b for b, _, _ in summary) + 1  # the numbers of the broken run are given out again
    assert ids_of(store) == before | expected
    assert sum(added.values()) == len(expected - before)
    assert incremental.deliver(cleaned, store.path, **OPTIONS).count() == 0
    assert ids_of(store) == before | expected
    assert len(store.remove_abandoned()) == 1 and store.abandoned() == []
    assert ids_of(store) == before | expected


@needs_tables
def test_files_of_an_unfinished_write_are_not_seen(spark, cleaned, expected, tmp_path):
    store = Deliveries(spark, str(tmp_path / "store"))
    part = cleaned.limit(100).withColumn("batch", F.lit(0))
    writers.write_batches(part, store.folder_of("000000-broken", "data"))
    assert store.messages().count() == 0 and store.next_batch() == 0
    incremental.deliver(cleaned, store.path, **OPTIONS)
    assert ids_of(store) == expected
    records = sorted(map(tuple, store.summary().collect()))
    assert records == sorted(map(tuple, batches.batch_summary(store.messages()).select("batch", "messages", "user_weeks").collect()))


def test_two_runs_at_a_time_cannot_both_commit(spark, tmp_path):
    store = Deliveries(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], "batch bigint, messages bigint, user_weeks bigint")
    store._commit(0, "000000-one", none)
    with pytest.raises(Exception, match="(?i)already exists"):
        store._commit(0, "000000-other", none)
    assert store.folders() == ["000000-one"] and store.summary().count() == 0 and store.next_batch() == 0


def reads_messages(df):
    return any("/data/run=" in f for f in df.inputFiles())


@needs_tables
def test_the_same_rows_as_drop_existing_without_reading_a_message(spark, cleaned, tmp_path):
    store = Deliveries(spark, str(tmp_path / "store"))
    early = cleaned.filter(F.col("created_at") < F.lit("2024-01-11").cast("timestamp")).withColumn("batch", F.lit(0))
    store.write(early)
    index = store.ids()
    assert index.dense.count() == 1 and index.sparse.count() == 0
    new = membership.drop_indexed(cleaned, index)
    other = batches.drop_existing(cleaned, store.messages())
    assert new.columns == cleaned.columns
    assert new.exceptAll(other.select(*new.columns)).isEmpty() and other.select(*new.columns).exceptAll(new).isEmpty()
    assert reads_messages(other) and not reads_messages(new)


@pytest.mark.parametrize("dense", [1, 40, 10**6])
def test_membership_is_exact_for_every_kind_of_id(spark, dense):
    rng = random.Random(dense)
    held = {rng.randrange(-(2**62), 2**62) for _ in range(300)} | set(range(32_700, 32_900)) | {0, 1, -1, -32_768, 2**63 - 1, -(2**63) + 1}
    asked = held | {rng.randrange(-(2**62), 2**62) for _ in range(300)} | {k + d for k in held for d in (-1, 1) if abs(k) < 2**62}
    rows = spark.createDataFrame([(k,) for k in held] + [(0,), (None,)], "message_id bigint")
    index = membership.index_ids(rows, dense=dense)
    messages = spark.createDataFrame([(k, "x") for k in asked] + [(None, "y"), (1, "again")], "message_id bigint, bucket string")
    got = membership.marked(messages, index).collect()
    assert len(got) == len(asked) + 2
    assert all(r["_written"] == (r["message_id"] in held) for r in got)
    halves = [membership.index_ids(rows.filter(F.col("message_id") % 2 == k), dense=dense) for k in (0, 1, -1)]
    again = membership.drop_indexed(messages, membership.united(halves)).collect()
    assert {r["message_id"] for r in again} == (asked - held) | {None}


@needs_tables
def test_statistics_of_any_batches_without_reading_a_message(spark, cleaned, tmp_path):
    store = Deliveries(spark, str(tmp_path / "store"))
    for part in (0, 1, 2):
        rows = cleaned.filter(F.col("message_id") % 3 == part)
        store.write(rows.withColumn("batch", F.lit(2 * part) + (F.col("user_id") % 2).cast("int")))
    everything = store.messages()
    for chosen in (None, [0], [1, 4], [0, 1, 2, 3, 4, 5], [9], []):
        rows = everything if chosen is None else everything.filter(F.col("batch").isin(chosen))
        exact, got = activity.panel_stats(rows).first(), store.statistics(chosen).first()
        assert got["messages"] == exact["messages"] and got["counties"] == exact["counties"]
        for name in ("user_weeks", "users"):
            assert abs(got[name] - exact[name]) <= sketches.ERROR * exact[name]
    assert not reads_messages(store.statistics())


def test_the_error_bound_of_united_sketches(spark):
    """Half a million users in eight batches that overlap by half."""
    rows = spark.range(500_000).select(
        F.col("id").alias("message_id"), F.col("id").alias("user_id"), F.col("id").cast("string").alias("user_year_week"),
        F.explode(F.array(F.col("id") % 8, (F.col("id") + 1) % 8)).alias("batch"), F.lit("01001").alias("fips"),
    )
    parts = sketches.summarised(rows), sketches.county_bitmaps(rows)
    got = sketches.united_statistics(*parts).first()
    assert got["messages"] == 1_000_000 and got["counties"] == 1
    assert abs(got["users"] - 500_000) <= sketches.ERROR * 500_000
    assert abs(got["user_weeks"] - 500_000) <= sketches.ERROR * 500_000
