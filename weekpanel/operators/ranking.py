"""Row numbers and running totals over a global order, without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel.session import small_side, stage

#: Partitions of a numbering: one size of each goes through the driver, and its join is with as many rows.
MOST_RANGES = 2_000
_SLOT_BITS = 33  # monotonically_increasing_id: partition number above, row number below
Order = Sequence["str | Column"]


def _columns(order: Order) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


def _placed(df: DataFrame, order: Order, label: str, scans: Mapping[str, Column] | None = None) -> DataFrame:
    """Range-partition and sort by ``order``, give each row its slot, and stage: slots must not move later.

    ``scans`` are further columns that depend on the rows of the partition before.
    """
    columns = _columns(order)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(*columns) if usual <= MOST_RANGES else df.repartitionByRange(MOST_RANGES, *columns)
    in_order = ranged.sortWithinPartitions(*columns)
    return stage(in_order.withColumns({"_slot": F.monotonically_increasing_id(), **(scans or {})}), label)


def _part() -> Column:
    return F.shiftright(F.col("_slot"), _SLOT_BITS)


def _row_in_part() -> Column:
    return F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))


def _with_part_start(placed: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """Join each row with the running total before its partition. ``sizes`` has one entry per partition."""
    starts, total = [], 0
    for part, size in sorted(sizes):
        starts.append((part, total))
        total += size
    offsets = small_side(placed.sparkSession, starts, "_part bigint, _start bigint")
    return placed.withColumn("_part", _part()).join(offsets, "_part")


def number_rows(df: DataFrame, order: Order, id_col: str = "id", start: int = 1) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` by ``order``, which must be unique per row.

    Each partition is numbered where it lies; the driver sees one count per partition, and what is joined is
    that list.
    """
    placed = _placed(df, order, "numbered")
    sizes = [(r["part"], r["n"]) for r in placed.groupBy(_part().alias("part")).agg(F.count("*").alias("n")).collect()]
    numbered = _with_part_start(placed, sizes)
    row = F.col("_start") + _row_in_part() + F.lit(start)
    return numbered.select(row.cast("bigint").alias(id_col), *df.columns)


@F.pandas_udf(T.LongType())
def _running(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sum of the sizes before each row of a partition, in the order in which the rows come."""
    total = 0
    for batch in sizes:
        sums = batch.cumsum()
        yield sums - batch + total
        total += int(batch.sum())


def running_start(df: DataFrame, order: Order, size: Column, out: str = "start") -> DataFrame:
    """Sum of ``size`` over all rows before each row, by ``order``, which must be unique per row; a null size adds 0.

    One shuffle: each range partition is sorted and summed by a scan before it is staged. Only the sizes go through the
    scan, the other columns stay where they are. The partitions' totals are added afterwards.
    """
    sized = df.withColumn("_size", F.coalesce(size.cast("bigint"), F.lit(0)))
    placed = _placed(sized, order, "running", {"_before": _running.asNondeterministic()("_size")})
    totals = placed.groupBy(_part().alias("part")).agg(F.sum("_size").alias("n")).collect()
    based = _with_part_start(placed, [(r["part"], r["n"]) for r in totals])
    return based.select((F.col("_start") + F.col("_before")).cast("bigint").alias(out), *df.columns)


def sort_weeks_by_count(weeks: DataFrame, key: str = "user_year_week") -> DataFrame:
    """Ascending by count; equal counts by key."""
    return weeks.orderBy("message_count", key)


def sample_rows(df: DataFrame, order: Order, n: int) -> DataFrame:
    """The first ``n`` rows for inspection."""
    return df.orderBy(*_columns(order)).limit(n)


def extremes(df: DataFrame, col: str, ties: Sequence[str], k: int = 10, accuracy: int = 10_000) -> DataFrame:
    """The ``k`` lowest, middle and highest rows by ``col``, labelled in ``part``; nulls are left out.

    Lowest and highest are top-k reports: every task keeps ``k`` rows. The middle starts ``k // 2`` rows before the
    half. A quantile sketch, off by at most a part in ``accuracy`` of the rows, gives the values between which it lies;
    the rows below them are counted, and only the rows between them are ordered and numbered. The counts tell whether
    the sketch kept its word; for values that it cannot hold, such as texts, all rows are between. The rows are staged,
    because they are read several times.
    """
    scored = stage(df.filter(F.col(col).isNotNull()), "scored")
    ascending = [F.col(c).asc_nulls_last() for c in (col, *ties)]
    descending = [F.col(c).desc_nulls_first() for c in (col, *ties)]
    rows, low, high = _around_the_middle(scored, col, k, accuracy)
    first = rows // 2 - k // 2
    below, inside = 0, scored
    if low is not None:
        between = F.col(col).between(F.lit(low), F.lit(high))
        counts = scored.agg(F.count_if(F.col(col) < F.lit(low)).alias("below"), F.count_if(between).alias("inside")).first()
        if counts["below"] <= max(first, 0) and first + k <= counts["below"] + counts["inside"]:
            below, inside = counts["below"], scored.filter(between)
    numbered = number_rows(inside, [col, *ties], id_col="_row", start=below)
    place = F.col("_row")
    parts = {
        "lowest": scored.orderBy(*ascending).limit(k),
        "middle": numbered.filter((place >= max(first, 0)) & (place < first + k)).drop("_row"),
        "highest": scored.orderBy(*descending).limit(k),
    }
    labelled = [part.select(F.lit(name).alias("part"), *df.columns) for name, part in parts.items()]
    return labelled[0].unionByName(labelled[1]).unionByName(labelled[2])


def _around_the_middle(scored: DataFrame, col: str, k: int, accuracy: int) -> tuple[int, object, object]:
    """Number of rows, and values on either side of the middle ``k``; no values where a sketch cannot hold the column."""
    if not isinstance(scored.schema[col].dataType, T.NumericType):
        return scored.count(), None, None
    rows = scored.count()
    margin = (k + 1) / max(rows, 1) + 2 / accuracy
    shares = [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)]
    low, high = scored.agg(F.percentile_approx(col, shares, accuracy).alias("cuts")).first()["cuts"] or (None, None)
    return rows, low, high
