"""Writers of batches, CSV tables, heavy users and week counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel import schemas
from weekpanel.session import use_corrected_timestamps
from weekpanel.sources.readers import FILE, RECORD


def write_batches(members: DataFrame, path: str, mode: str = "append") -> None:
    """All batches in one job, one directory per ``batch``.

    Rows are rebalanced by batch first: a batch larger than the advisory partition size is split over several
    tasks and files, small ones share a task, and no task holds files of all batches open.
    """
    use_corrected_timestamps(members.sparkSession)
    columns = [f.name for f in schemas.SAMPLED.fields if f.name in members.columns]
    rows = members.select(*columns, "batch").hint("rebalance", "batch")
    rows.write.partitionBy("batch").mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, files: int | None = None, mode: str = "append") -> None:
    """CSV. ``files`` sets the number of part files: 1 suits a finished rollup, the default suits a long table.

    The rows are redistributed for it, so what computes them keeps its parallelism.
    """
    rows = df if files is None else df.repartition(files)
    rows.write.option("header", header).option("quote", '"').option("escape", '"').mode(mode).csv(path)


def write_quarantine(checked: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Set aside the records of :func:`readers.read_checked` that did not parse, and return the messages that did.

    The records are written as Parquet with the file they come from.
    """
    broken = checked.filter(F.col(RECORD).isNotNull()).select(FILE, RECORD)
    broken.write.mode(mode).parquet(path)
    return checked.filter(F.col(RECORD).isNull()).drop(RECORD, FILE)


def quarantine_report(checked: DataFrame) -> DataFrame:
    """Messages and broken records per file."""
    broken = F.col(RECORD).isNotNull()
    return checked.groupBy(FILE).agg(F.count_if(~broken).alias("messages"), F.count_if(broken).alias("broken"))


def write_superusers(users: DataFrame, path: str, mode: str = "append") -> None:
    """Distinct heavy users as Parquet."""
    users.select("user_id").distinct().write.mode(mode).parquet(path)


def write_week_counts(counts: DataFrame, path: str, files: int | None = None, mode: str = "append") -> None:
    """``user_year_week, message_count`` as CSV with a header."""
    write_csv(counts.select("user_year_week", F.col("message_count").cast("bigint")), path, True, files, mode)
