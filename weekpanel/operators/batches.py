"""Size-bounded batches of whole user-weeks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.fixed_values import BATCH_LIMIT
from weekpanel.operators.ranking import number_rows
from weekpanel.session import small_side, stage

KEY = "user_year_week"
_PLAN = "message_count bigint, _first bigint, _batch bigint, _room bigint, _per_batch bigint"


def drop_existing(messages: DataFrame, prior: DataFrame) -> DataFrame:
    """Messages whose id no earlier batch holds."""
    return messages.join(prior.select("message_id"), "message_id", "left_anti")


def plan_batches(
    histogram: Iterable[tuple[int, int]], limit: int, start: int = 0
) -> Iterator[tuple[int, int, int, int, int]]:
    """Where the user-weeks of each count go, when they are taken in ascending order of their count.

    ``histogram`` gives (message_count, user-weeks) in that order. Within one count all user-weeks weigh the
    same, so some number of them still fit in the open batch and the rest fill batches of equal length; no
    user-week has to be looked at. Yields (count, user-weeks before it, open batch, room in the open batch,
    user-weeks per further batch). A user-week above the limit gets a batch of its own.
    """
    batch, used, before = start, 0, 0
    for count, weeks in histogram:
        per_batch = max(1, limit // count) if count > 0 else weeks
        room = per_batch if used == 0 else (max(0, (limit - used) // count) if count > 0 else weeks)
        yield count, before, batch, room, per_batch
        if weeks <= room:
            used += weeks * count
        else:
            rest = weeks - room
            opened = -(-rest // per_batch)
            batch += opened
            used = (rest - (opened - 1) * per_batch) * count
        before += weeks


def assign_batches(
    weeks: DataFrame,
    limit: int = BATCH_LIMIT,
    start: int = 0,
    max_batches: int | None = None,
    drop_tail: bool = False,
) -> DataFrame:
    """Give each user-week of (``user_year_week``, ``message_count``) a ``batch``.

    User-weeks are walked by ascending count (equal counts by key) and a batch is closed before the user-week
    that would take it over ``limit``. The walk is done on the histogram of the counts: N messages have at
    most sqrt(2 N) different counts, and the usual band has 90. Rows are placed by their number in the global
    order. ``max_batches`` leaves later user-weeks to the next run; ``drop_tail`` leaves out the batch that is
    still open at the end.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    numbered = number_rows(weeks.select(KEY, "message_count"), ["message_count", KEY], id_col="_row", start=0)
    histogram = numbered.groupBy("message_count").agg(F.count("*").alias("weeks")).orderBy("message_count")
    rows = ((r["message_count"], r["weeks"]) for r in histogram.toLocalIterator())
    plan = small_side(weeks.sparkSession, list(plan_batches(rows, limit, start)), _PLAN)
    place = F.col("_row") - F.col("_first") - F.col("_room")
    batch = F.when(place < 0, F.col("_batch")).otherwise(F.col("_batch") + 1 + F.floor(place / F.col("_per_batch")))
    assigned = numbered.join(plan, "message_count").select(KEY, "message_count", batch.cast("bigint").alias("batch"))
    if max_batches is not None:
        assigned = assigned.filter(F.col("batch") < start + max_batches)
    if drop_tail:
        last = numbered.join(plan, "message_count").agg(F.max(batch)).scalar()
        assigned = assigned.filter(F.col("batch") < last)
    return assigned


def batch_members(messages: DataFrame, assigned: DataFrame) -> DataFrame:
    """Messages with the batch of their user-week; messages of other user-weeks drop out.

    The batches are staged, so they are given out once and a hot user-week can be split in the join.
    """
    return messages.join(stage(assigned.select(KEY, "batch"), "assigned"), KEY, "inner")


def next_batch_number(existing: DataFrame) -> DataFrame:
    """One row: the number after the largest batch, 0 when there is none."""
    return existing.agg(F.coalesce(F.max("batch") + 1, F.lit(0)).cast("bigint").alias("next_batch"))


def batch_summary(members: DataFrame) -> DataFrame:
    """Messages and user-weeks per batch. User-weeks are counted after they were summed up one by one."""
    per_week = members.groupBy("batch", KEY).agg(F.count("message_id").alias("n"))
    return per_week.groupBy("batch").agg(F.sum("n").alias("messages"), F.count(KEY).alias("user_weeks"))
