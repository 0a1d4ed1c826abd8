import pytest
from hypothesis import given
from hypothesis import settings as example_settings
from hypothesis import strategies as st

from weekpanel import session
from weekpanel.operators import batches


def walk(counts, limit, start=0):
    """The rule itself: one user-week at a time, smallest first."""
    batch, used, given_out = start, 0, []
    for key, count in sorted(counts, key=lambda c: (c[1], c[0])):
        if used and used + count > limit:
            batch, used = batch + 1, 0
        given_out.append((key, count, batch))
        used += count
    return given_out


def place(counts, limit, start=0):
    """The rule by the plan of the histogram."""
    ordered = sorted(counts, key=lambda c: (c[1], c[0]))
    histogram = {}
    for _, count in ordered:
        histogram[count] = histogram.get(count, 0) + 1
    plan = {row[0]: row[1:] for row in batches.plan_batches(sorted(histogram.items()), limit, start)}
    given_out = []
    for row, (key, count) in enumerate(ordered):
        before, batch, room, per_batch = plan[count]
        number = row - before - room
        given_out.append((key, count, batch if number < 0 else batch + 1 + number // per_batch))
    return given_out


@example_settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60), st.integers(1, 40), st.integers(0, 5))
def test_histogram_plan_equals_the_walk(sizes, limit, start):
    counts = [(f"k{i:03d}", size) for i, size in enumerate(sizes)]
    assert place(counts, limit, start) == walk(counts, limit, start)


WEEKS = "user_year_week string, message_count long"


@pytest.mark.parametrize(("limit", "start"), [(1, 0), (5, 0), (17, 3), (100, 1), (10**9, 0)])
def test_assignment_equals_the_walk(spark, limit, start):
    counts = [(f"k{i:03d}", 1 + (i * 7) % 13) for i in range(150)]
    assigned = batches.assign_batches(spark.createDataFrame(counts, WEEKS).repartition(4), limit, start)
    assert sorted(map(tuple, assigned.collect())) == sorted(walk(counts, limit, start))


def test_no_weeks_give_no_batches(spark):
    empty = spark.createDataFrame([], WEEKS)
    assert batches.assign_batches(empty, 10).count() == 0
    assert batches.assign_batches(empty, 10, drop_tail=True).count() == 0


def test_a_week_above_the_limit_has_its_own_batch(spark):
    df = spark.createDataFrame([("a", 3), ("b", 50), ("c", 60)], WEEKS)
    assert {r[0]: r[2] for r in batches.assign_batches(df, 10).collect()} == {"a": 0, "b": 1, "c": 2}


def test_batch_cap_and_open_tail(spark):
    counts = [(f"k{i}", 5) for i in range(10)]
    df = spark.createDataFrame(counts, WEEKS)
    capped = batches.assign_batches(df, 10, start=7, max_batches=2)
    assert sorted({r["batch"] for r in capped.collect()}) == [7, 8]
    assert capped.count() == 4
    tailless = batches.assign_batches(df, 10, drop_tail=True)
    assert sorted({r["batch"] for r in tailless.collect()}) == [0, 1, 2, 3]


def test_long_plans_are_joined_by_a_shuffle(spark, monkeypatch, settings, physical_plan):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    counts = [(f"k{i:03d}", 1 + i) for i in range(60)]
    df = spark.createDataFrame(counts, WEEKS)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assigned = batches.assign_batches(df, 100)
    assert "BroadcastHashJoin" not in physical_plan(assigned)
    assert sorted(map(tuple, assigned.collect())) == sorted(walk(counts, 100))


def test_limit_must_be_positive(spark):
    with pytest.raises(ValueError, match="limit"):
        batches.assign_batches(spark.createDataFrame([], WEEKS), 0)


def test_members_summary_and_next_number(spark):
    messages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "user_year_week string, message_id long")
    assigned = spark.createDataFrame([("a", 4), ("b", 5)], "user_year_week string, batch long")
    members = batches.batch_members(messages, assigned)
    assert sorted((r["message_id"], r["batch"]) for r in members.collect()) == [(1, 4), (2, 4), (3, 5)]
    assert sorted(map(tuple, batches.batch_summary(members).collect())) == [(4, 2, 1), (5, 1, 1)]
    assert batches.next_batch_number(members).first()[0] == 6
    assert batches.next_batch_number(members.limit(0)).first()[0] == 0


def test_existing_messages_are_dropped_once(spark):
    messages = spark.createDataFrame([(1,), (2,), (3,)], "message_id long")
    prior = spark.createDataFrame([(2,), (2,), (None,)], "message_id long")
    assert sorted(r[0] for r in batches.drop_existing(messages, prior).collect()) == [1, 3]
