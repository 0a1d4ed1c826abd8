"""The panel of active user-weeks without heavy users, and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.fixed_values import ACTIVE_WEEK, SUPER_WEEK_FROM
from weekpanel.operators import activity
from weekpanel.session import stage

KEY = activity.KEY


def activity_panel(
    cleaned: DataFrame,
    active: tuple[int, int] = ACTIVE_WEEK,
    super_from: int | None = SUPER_WEEK_FROM,
    staged: bool = False,
) -> DataFrame:
    """Messages of active user-weeks whose user has no heavy week; ``super_from=None`` keeps heavy users.

    The cleaned rows are counted, then selected from. They are staged in between unless the caller says that
    they lie in a table already (``staged=True``), so cleaning runs once.
    """
    rows = cleaned if staged else stage(cleaned, "cleaned")
    kept = activity.active_counts(activity.staged_counts(rows), active, super_from)
    return activity.keep_band(rows, kept, (KEY, "user_id"))


def activity_report(
    cleaned: DataFrame, active: tuple[int, int] = ACTIVE_WEEK, super_from: int | None = SUPER_WEEK_FROM
) -> DataFrame:
    """Messages, user-weeks, users and counties of :func:`activity_panel`, in one row.

    ``cleaned`` must be unique by message id. Everything asked for is in the counts per user-week, user and
    county, so the messages are read and aggregated once and the panel itself is never built.
    """
    counts = activity.staged_counts(cleaned, (KEY, "user_id", "fips"))
    return activity.panel_stats_from_weeks(activity.active_counts(counts, active, super_from))


def before_after_report(
    cleaned: DataFrame, active: tuple[int, int] = ACTIVE_WEEK, super_from: int = SUPER_WEEK_FROM
) -> DataFrame:
    """The statistics of the active user-weeks before and after heavy users are removed: two rows, told by ``heavy_users``.

    ``cleaned`` must be unique by message id. The counts per user-week, user and county are tagged with whether their user
    has a heavy week, and one aggregation over two grouping sets gives both rows: all of them, and those by the tag.
    Where nothing is left, a row of zeros stands.
    """
    weeks = activity.with_week_totals(activity.staged_counts(cleaned, (KEY, "user_id", "fips")))
    heavy = stage(activity.heavy_users(weeks, super_from).withColumn("_heavy", F.lit(True)), "heavy")
    tagged = (
        weeks.filter(activity.in_band(F.col("week_total"), *active))
        .join(heavy, "user_id", "left")
        .withColumn("_heavy", F.coalesce("_heavy", F.lit(False)))
    )
    sets = tagged.groupingSets([[], ["_heavy"]], "_heavy").agg(
        F.grouping("_heavy").alias("_all"), *activity.week_statistics()
    )
    told = sets.filter((F.col("_all") == 1) | ~F.col("_heavy")).select(
        F.when(F.col("_all") == 1, F.lit("kept")).otherwise(F.lit("removed")).alias("heavy_users"), *activity.STATISTICS
    )
    labels = cleaned.sparkSession.createDataFrame([("kept",), ("removed",)], "heavy_users string")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in activity.STATISTICS]
    return labels.join(told, "heavy_users", "left").select("heavy_users", *numbers)


def band_report(cleaned: DataFrame, edges: activity.Edges = activity.BANDS) -> DataFrame:
    """User-weeks, messages, users and counties per band, from one aggregation over the messages."""
    weeks = activity.with_week_totals(activity.staged_counts(cleaned, (KEY, "user_id", "fips")))
    banded = activity.band(weeks, edges, "week_total").filter(F.col("band").isNotNull())
    return banded.groupBy("band").agg(
        F.count_distinct(KEY).alias("user_weeks"),
        F.sum("message_count").alias("messages"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("fips").alias("counties"),
    )
