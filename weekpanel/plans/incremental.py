"""New messages of the active panel, in size-bounded batches that follow the earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.fixed_values import ACTIVE_WEEK, BATCH_LIMIT, SUPER_WEEK_FROM
from weekpanel.operators import activity, batches, membership
from weekpanel.session import stage
from weekpanel.sources import readers, writers
from weekpanel.sources.deliveries import Deliveries

KEY = activity.KEY


def incremental_batches(
    cleaned: DataFrame,
    prior: DataFrame,
    *,
    active: tuple[int, int] = ACTIVE_WEEK,
    super_from: int | None = SUPER_WEEK_FROM,
    limit: int = BATCH_LIMIT,
    max_batches: int | None = None,
    drop_tail: bool = False,
) -> DataFrame:
    """Messages of the panel that no earlier batch holds, each with its new ``batch``.

    Bands and heavy users are judged on all messages, batch sizes on the new ones. Whether a message is new is
    marked while the rows still lie by message id from the removal of duplicates, so the earlier ids are the
    only side that is shuffled for it. The marked rows are staged once; counting them reads two columns and
    a flag, and the batches are given out by one join with the kept user-weeks.
    """
    earlier = prior.select("message_id").distinct().withColumn("_written", F.lit(True))
    marked = cleaned.join(earlier, "message_id", "left").withColumn("_new", F.col("_written").isNull())
    start = batches.next_batch_number(prior).first()["next_batch"]
    rows = marked.select(*cleaned.columns, "_new")
    return _in_batches(rows, start, active, super_from, limit, max_batches, drop_tail)


def _in_batches(
    marked: DataFrame,
    start: int,
    active: tuple[int, int],
    super_from: int | None,
    limit: int,
    max_batches: int | None,
    drop_tail: bool,
) -> DataFrame:
    """Rows marked as ``_new`` of the active panel with their batch, numbered on from ``start``."""
    rows = stage(marked, "marked")
    counts = activity.staged_counts(rows, extra={"_new_count": F.count_if("_new")})
    kept = activity.active_counts(counts, active, super_from)
    fresh = kept.filter(F.col("_new_count") > 0)
    assigned = batches.assign_batches(
        fresh.groupBy(KEY).agg(F.sum("_new_count").alias("message_count")), limit, start, max_batches, drop_tail
    )
    places = stage(fresh.select(KEY, "user_id").join(assigned.select(KEY, "batch"), KEY), "places")
    return rows.filter("_new").drop("_new").join(places, [KEY, "user_id"])


def deliver(
    cleaned: DataFrame,
    path: str,
    *,
    active: tuple[int, int] = ACTIVE_WEEK,
    super_from: int | None = SUPER_WEEK_FROM,
    limit: int = BATCH_LIMIT,
    max_batches: int | None = None,
    drop_tail: bool = False,
) -> DataFrame:
    """Add the new batches to the store at ``path`` (:class:`Deliveries`) as one run; the summary of its batches.

    The batches are those of :func:`incremental_batches`. Whether a message was delivered before is asked of the
    store's index of ids, and the next number of its commit records, so no earlier message is read. A run that breaks
    off leaves nothing that the next one sees, and a run that is repeated adds nothing.
    """
    store = Deliveries(cleaned.sparkSession, path)
    marked = membership.marked(cleaned, store.ids()).withColumn("_new", ~F.col("_written")).drop("_written")
    rows = _in_batches(marked, store.next_batch(), active, super_from, limit, max_batches, drop_tail)
    return store.write(rows)


def write_increment(cleaned: DataFrame, path: str, **options) -> DataFrame:
    """Append the new batches to ``path`` and return the summary of the batches written by this call.

    A second run over the same messages adds nothing. Options are those of :func:`incremental_batches`.
    """
    prior = readers.read_batches(cleaned.sparkSession, path)
    start = batches.next_batch_number(prior).first()["next_batch"]
    writers.write_batches(incremental_batches(cleaned, prior, **options), path)
    written = readers.read_batches(cleaned.sparkSession, path).filter(F.col("batch") >= start)
    return batches.batch_summary(written)
