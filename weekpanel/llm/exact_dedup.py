"""Operator 6: exact duplicates with a heavy-hitter split.

Documents are reduced to (row, doc_id, digest of the normalised text) and staged. Misra-Gries summaries, built per
block of rows and merged in a tree of ordinary aggregations, give at most ``counters`` digests that may be frequent;
every digest on more than 1 / (counters + 1) of the rows is among them. Their exact sizes and winners are counted over
all rows with map-side aggregation, and, being at most ``counters`` rows, broadcast: copies of frequent texts are
settled where they lie and never shuffled. The winners and sizes of the other digests, each on a bounded share of the
rows, are aggregated as well, staged, and joined back by an ordinary shuffle, which adaptive execution can split.

Defined results: null counts as the empty text; the row with the largest doc_id stays, a null doc_id being the
smallest; of repeated rows with the same doc_id and text exactly one stays; an empty table gives no rows; further
columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.llm.shared import Staging, lower_ascii, whole_text

COUNTERS = 1000
BLOCK_ROWS = 65_536
MERGE = 16


def digests(docs: DataFrame) -> DataFrame:
    """row (unique), doc_id and the SHA-256 of the text after lower-casing A-Z."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(lower_ascii(whole_text()).cast("binary"), 256)).alias("digest"),
    )


def _summary(counts: DataFrame, counters: int) -> DataFrame:
    """Misra-Gries: per block, take the (counters + 1)-th largest count off all counts and keep what is left."""
    by_count = Window.partitionBy("block").orderBy(F.col("n").desc(), "digest")
    ranked = counts.withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= counters + 1)
    off = F.max(F.when(F.col("place") == counters + 1, F.col("n"))).over(Window.partitionBy("block"))
    left = ranked.withColumn("n", F.col("n") - F.coalesce(off, F.lit(0)))
    return left.filter("n > 0").select("block", "digest", "n")


def frequent_candidates(rows: DataFrame, staging: Staging, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them all that are on more than 1 / (counters + 1) of the rows."""
    # monotonically_increasing_id numbers the rows of a partition on from partition << 33.
    block = F.struct(F.shiftright("row", 33).alias("part"), F.expr(f"(row & 8589934591L) div {BLOCK_ROWS}").alias("no"))
    counts = rows.groupBy(F.xxhash64(block).alias("block"), "digest").agg(F.count("*").alias("n"))
    level = 0
    summary = staging.write(_summary(counts, counters), f"summary{level}")
    # Blocks are hashes, so their remainders deal them evenly; every merge divides their number by MERGE.
    blocks = summary.select("block").distinct().count()
    while blocks > 1:
        level += 1
        blocks = -(-blocks // MERGE)
        merged = summary.groupBy(F.expr(f"pmod(block, {blocks}L)").alias("block"), "digest").agg(F.sum("n").alias("n"))
        summary = staging.write(_summary(merged, counters), f"summary{level}")
    return summary.select("digest").distinct()


def mark_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    staging = Staging(docs.sparkSession, "exact-dedup")
    rows = staging.write(digests(docs), "rows")
    candidates = F.broadcast(frequent_candidates(rows, staging, counters))  # at most `counters` digests
    best = F.max(F.struct(F.col("doc_id"), F.col("row"))).alias("best")
    winners = staging.write(
        rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(best, F.count("*").alias("group_size")),
        "winners",
    )
    frequent = F.broadcast(winners)  # verified, at most `counters` rows
    settled = _decided(rows.join(frequent, "digest"))
    rare = rows.join(frequent.select("digest"), "digest", "left_anti")
    sizes = staging.write(rare.groupBy("digest").agg(best, F.count("*").alias("group_size")), "sizes")
    others = _decided(rare.join(sizes, "digest"))
    return settled.unionByName(others).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def _decided(rows: DataFrame) -> DataFrame:
    """Each row beside the best one and the size of its group."""
    return rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
    )
