"""Joins whose large side may hold a key on a third of all rows, split by plan and not only at run time.

Adaptive execution splits a hot key of a join where both sides come straight from a shuffle. Elsewhere, and where it is
off, this join does the same in the plan: keys that are on more than a set share of the large side's rows are dealt over
several salts, and the few rows of the other side that they meet are repeated once per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.session import BROADCAST_ROWS, stage

#: A key on more than this share of the rows is hot. There are at most so many hot keys as its inverse.
SHARE = 1 / 1_000
HOWS = ("inner", "left", "left_semi", "left_anti")


def hot_keys(large: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """(key, salts): the keys on more than ``share`` of the rows, and over how many salts to deal each of them.

    Counted over all rows with partial sums on the map side. The rows of one salt are a share of ``share`` at most.
    """
    if not 1 / BROADCAST_ROWS <= share <= 1:
        raise ValueError(f"share must be from {1 / BROADCAST_ROWS} to 1")
    counts = stage(large.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")), "key-counts")
    rows = counts.agg(F.sum("_n")).scalar()
    salts = F.ceil(F.col("_n") / (rows * F.lit(share))).cast("int")
    hot = counts.filter(F.col("_key").isNotNull() & (F.col("_n") > rows * F.lit(share)))
    return stage(hot.select("_key", salts.alias("_salts")), "hot-keys")


def salted_join(large: DataFrame, small: DataFrame, key: str, how: str = "inner", share: float = SHARE) -> DataFrame:
    """``large.join(small, key, how)`` for a hot key on the large side; no task gets all its rows.

    The hot keys are fewer than 1 / ``share`` rows and broadcast. Rows of the large side take a salt in turn as they lie;
    those of other keys, null ones included, have salt 0. Rows of the other side are repeated for the salts of their key.
    """
    if how not in HOWS:
        raise ValueError(f"how must be one of {HOWS}")
    hot = F.broadcast(hot_keys(large, key, share))
    columns = large.columns
    known = large.join(hot, F.col(key) == F.col("_key"), "left")
    turn = F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1)))
    dealt = known.select(*columns, F.coalesce(turn, F.lit(0)).cast("int").alias("_salt"))
    other = small.join(hot, F.col(key) == F.col("_key"), "left")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt")
    return dealt.join(other.select(*small.columns, salts), [key, "_salt"], how).drop("_salt")
