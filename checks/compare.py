"""Run queries and their SQL side by side: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.adapters import TABLES
from checks.registry import ORACLE, QUERIES
from weekpanel.session import configure


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, columns by name, every missing value as None."""
    frame = frame[sorted(frame.columns)].astype(object)
    values = frame.where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted((tuple(v.item() if hasattr(v, "item") else v for v in row) for row in values), key=repr)


def difference(spark: SparkSession, connection: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """What differs between a query and its SQL; None if nothing does."""
    got = QUERIES[name](spark, folder).toPandas()
    if name not in ORACLE:
        return None
    want = connection.execute(ORACLE[name]).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    if not len(got):
        return "no rows"
    unequal = [(a, b) for a, b in zip(rows(got), rows(want), strict=True) if a != b]
    return f"{len(unequal)} unequal rows, first {unequal[0]}" if unequal else None


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> None:
    builder = configure(SparkSession.builder.master("local[8]")).config("spark.sql.shuffle.partitions", "8")
    spark = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(folder), 0
    for name in names or QUERIES:
        begun = time.time()
        try:
            found = difference(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001 - every query is to be tried
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{time.time() - begun:6.2f}  {name}: {found or 'equal'}", flush=True)
    print(f"{failed} of {len(names or QUERIES)} differ")


if __name__ == "__main__":
    main(*sys.argv[1:])
