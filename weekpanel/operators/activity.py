"""Activity of user-weeks: counts, bands, heavy users, panel statistics, row funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.fixed_values import ACTIVE_WEEK, QUIET_WEEK, SUPER_WEEK_FROM
from weekpanel.session import stage

KEY = "user_year_week"
Edges = Mapping[str, tuple[int, "int | None"]]
BANDS: Edges = {"1-10": QUIET_WEEK, "11-100": ACTIVE_WEEK, "101+": (SUPER_WEEK_FROM, None)}


def week_counts(messages: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Messages per user-week. Counted on the map side first, so a hot user-week costs one row per task."""
    return messages.groupBy(*keys).agg(F.count("message_id").alias("message_count"))


def in_band(count: Column, low: int, high: int | None) -> Column:
    return (count >= low) if high is None else count.between(low, high)


def band(counts: DataFrame, edges: Edges = BANDS, col: str = "message_count") -> DataFrame:
    """Label each row with the first band its count lies in; null outside all of them."""
    label = F.lit(None).cast("string")
    for name, (low, high) in reversed(list(edges.items())):
        label = F.when(in_band(F.col(col), low, high), F.lit(name)).otherwise(label)
    return counts.withColumn("band", label)


def band_totals(banded: DataFrame) -> DataFrame:
    """User-weeks and messages per band, from one row per user-week."""
    return (
        banded.filter(F.col("band").isNotNull())
        .groupBy("band")
        .agg(F.count(KEY).alias("user_weeks"), F.sum("message_count").alias("messages"))
    )


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def keep_band(messages: DataFrame, weeks: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Messages of the given user-weeks, which are staged so that a hot user-week can be split in the join."""
    return messages.join(stage(weeks.select(*keys), "weeks"), list(keys), "left_semi")


def drop_superusers(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Anti-join on the user: one heavy week removes all weeks of its user.

    The users are staged so that a hot user can be split in the join.
    """
    return messages.join(stage(users.select("user_id"), "users"), "user_id", "left_anti")


def staged_counts(
    messages: DataFrame, keys: Sequence[str] = (KEY, "user_id"), extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Counts per user-week and further keys, staged: the messages are read once, however often the counts are.

    Without staging each use of the counts would keep other columns and read the messages again for itself.
    Messages without a key are left out, as no user-week join could find them.
    """
    counts = [F.count("message_id").alias("message_count"), *[c.alias(name) for name, c in (extra or {}).items()]]
    return stage(messages.filter(F.col(KEY).isNotNull()).groupBy(*keys).agg(*counts), "counts")


def with_week_totals(counts: DataFrame) -> DataFrame:
    """Add ``week_total``, the messages of the whole user-week, to counts by user-week and further keys.

    A key normally names its user, but it is text from outside. With the user kept beside it the bands follow
    the key and the heavy users follow the user, whatever the key says. Totals that are summed, staged and
    joined, rather than taken over a window, keep a key that many users share out of a single task.
    """
    totals = counts.groupBy(KEY).agg(F.sum("message_count").alias("week_total"))
    return counts.join(stage(totals, "totals"), KEY)


def heavy_users(weeks: DataFrame, from_count: int = SUPER_WEEK_FROM) -> DataFrame:
    return distinct_values(weeks.filter(F.col("week_total") >= from_count), ["user_id"])


def superusers(messages: DataFrame, from_count: int = SUPER_WEEK_FROM) -> DataFrame:
    """Users with at least one user-week of ``from_count`` messages or more."""
    return heavy_users(with_week_totals(staged_counts(messages)), from_count)


def active_counts(
    counts: DataFrame, active: tuple[int, int] = ACTIVE_WEEK, super_from: int | None = SUPER_WEEK_FROM
) -> DataFrame:
    """Rows of :func:`staged_counts` in the active band whose user has no heavy week; None keeps heavy users.

    The band and the heavy users are settled on the counts, which are far smaller than the messages, so the
    messages themselves meet one semi-join instead of two semi-joins and an anti-join.
    """
    weeks = with_week_totals(counts)
    kept = weeks.filter(in_band(F.col("week_total"), *active))
    return kept if super_from is None else drop_superusers(kept, heavy_users(weeks, super_from))


def panel_stats(df: DataFrame) -> DataFrame:
    """Distinct messages, user-weeks, users and counties in one row, of what ``df`` has; a null counts as one value.

    Messages are counted on their own narrow shuffle. The others are counted on their distinct combinations, so
    the multi-distinct expansion never runs over the messages. ``df`` is read twice, with few columns each time.
    """
    entities = [c for c in (KEY, "user_id", "fips") if c in df.columns]
    if "message_id" not in df.columns and not entities:
        raise ValueError("there is nothing to count")
    counted = distinct_values(df, entities).agg(*_entity_columns(entities)) if entities else None
    if "message_id" not in df.columns:
        return counted
    messages = df.groupBy("message_id").agg(F.lit(1).alias("one")).agg(F.count("one").alias("messages"))
    return messages if counted is None else _side_by_side(messages, counted)


def panel_stats_from_weeks(weeks: DataFrame) -> DataFrame:
    """The same row from (user-week, user, county, message_count) rows of messages already unique by id."""
    return weeks.agg(*week_statistics())


STATISTICS = ("messages", "user_weeks", "users", "counties")


def week_statistics() -> list[Column]:
    """The aggregates named in :data:`STATISTICS` over rows of (user-week, user, county, message_count)."""
    return [F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"), *_entity_columns()]


def approx_panel_stats(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """The same row by sketches: one pass, no shuffle of the values, nulls not counted."""
    names = {"messages": "message_id", "user_weeks": KEY, "users": "user_id", "counties": "fips"}
    return df.agg(*[F.approx_count_distinct(c, rsd).alias(name) for name, c in names.items()])


def _entity_columns(cols: Sequence[str] = (KEY, "user_id", "fips")) -> list[Column]:
    names = {KEY: "user_weeks", "user_id": "users", "fips": "counties"}

    def number(col: str) -> Column:
        return F.count_distinct(col) + F.coalesce(F.max(F.col(col).isNull().cast("int")), F.lit(0))

    return [number(c).cast("bigint").alias(names[c]) for c in cols]


def _side_by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two one-row tables as one row, by a scalar subquery."""
    (name,) = first.columns
    return second.select(first.scalar().alias(name), *second.columns)


def funnel(
    stages: Mapping[str, DataFrame | tuple[DataFrame, Mapping[str, Column]]], copies: Mapping[str, str] | None = None
) -> DataFrame:
    """Row count after each stage, one row per stage, in one job.

    A stage is a DataFrame, or a DataFrame with named conditions that are applied one after the other on top
    of it; such a run of filters is counted in a single pass. ``copies`` names, for a stage, the column that says
    how many rows a row stands for; without it a row is a row. The counts are exact even when tasks are run again after an executor was lost, which is not so
    for metrics observed while a shuffle is written.
    """
    counted = []
    for name, entry in stages.items():
        df, conditions = entry if isinstance(entry, tuple) else (entry, {})
        rows = F.col(copies[name]) if copies and name in copies else F.lit(1)
        passed, steps = F.lit(True), {name: F.lit(True)}
        for step, condition in conditions.items():
            passed = passed & F.coalesce(condition, F.lit(False))
            steps[step] = passed
        counts = df.agg(
            *[F.coalesce(F.sum(F.when(test, rows)), F.lit(0)).cast("bigint").alias(s) for s, test in steps.items()]
        )
        pairs = [F.struct(F.lit(s).alias("stage"), F.col(s).alias("row_count")) for s in steps]
        counted.append(counts.select(F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, counted)
