"""Operator 4: contiguous shards of near equal bytes, cut from global prefix sums of per-partition totals.

Only sizes are moved, never texts: documents are reduced to (doc_id, size, crc32) and a number of their own, staged,
range-partitioned by all of it and staged again, so that positions do not change between two reads and rows that are
equal in everything are spread like any others. One total per partition gives every partition its offset; a running sum
inside the partition adds the rest. A document goes to the shard in which its middle byte falls, so each cut is off its
target by half a document at most, repeated rows or not.

Defined results: a null text has size 1; null doc_ids come first; of rows equal in (doc_id, crc32, size) any may be the
first, and a cut may fall between them; an empty table gives no rows; with more shards than documents some shards are
empty. Further columns are left alone, one that is called ``shard`` included: the new one is then ``shard_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from weekpanel.llm.shared import Staging, fresh

SHARDS = 8
KEY = ("doc_id", "text_crc32", "size")


def sizes(docs: DataFrame) -> DataFrame:
    """One slim row per document: doc_id, size (UTF-8 bytes of the text, plus 1) and the text's crc32."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )


def contiguous_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot (position in the shard) of every document."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    staging = Staging(spark, "shards")
    slim = staging.write(sizes(docs).withColumn("_own", F.monotonically_increasing_id()), "sizes")
    order = [*(F.col(k).asc_nulls_first() for k in KEY), F.col("_own")]
    placed = staging.write(slim.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "placed")

    # One row per partition: its offset in bytes and rows, and the whole size.
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staging.write(
        totals.select(
            "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
        ),
        "offsets",
    )

    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumns({"_upto": F.sum("size").over(inside), "_row": F.row_number().over(inside)})
    # One row per partition on the small side; the planner may broadcast it.
    joined = running.join(offsets, "_part").withColumn(
        "_middle", 2 * (F.col("_bytes_before") + F.col("_upto")) - F.col("size")
    )
    shard = F.least(F.expr(f"({shards} * _middle) div (2 * _all)"), F.lit(shards - 1)).cast("int")
    cut = joined.select(*KEY, shard.alias("shard"), (F.col("_rows_before") + F.col("_row")).alias("_global"))
    numbered = staging.write(cut, "cut")
    firsts = numbered.groupBy("shard").agg(F.min("_global").alias("_first"))
    return numbered.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_global") - F.col("_first")).alias("slot"),
    )


def with_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of the documents and their shard.

    Shards are contiguous, so the first key of each says where it begins: as many comparisons as there are shards, and
    no text is shuffled. Only rows whose key lies on both sides of a cut need more: they are numbered as they lie and
    dealt out by the number of them that each shard has.
    """
    placed = contiguous_shards(docs, shards)
    first = placed.groupBy("shard").agg(F.min(F.struct(*_ordered())).alias("key"))
    bounds = {row["shard"]: row["key"] for row in first.collect()}  # at most one row per shard
    (name,) = fresh(docs.columns, "shard")
    key = F.struct(*_ordered(sizes_of=True))
    shard: Column = F.lit(0)
    for number in sorted(bounds):
        shard = F.when(key >= _literal(bounds[number]), F.lit(number)).otherwise(shard)
    told = docs.withColumn(name, shard.cast("int"))
    cut = _cut_keys(placed, list(bounds.values()))
    if not cut:
        return told
    on_a_cut = F.coalesce(F.reduce(F.array(*[key == _literal(k) for k, _ in cut]), F.lit(False), lambda a, b: a | b), F.lit(False))
    return told.filter(~on_a_cut).unionByName(_dealt(docs.filter(on_a_cut), key, cut, name))


def _literal(key: Row) -> Column:
    return F.struct(
        F.lit(key["known"]).alias("known"),
        *[F.lit(key[c]).cast("bigint").alias(c) for c in ("doc_id", "text_crc32", "size")],
    )


def _cut_keys(placed: DataFrame, firsts: list[Row]) -> list[tuple[Row, list[tuple[int, int]]]]:
    """Keys in several shards, each with its (shard, rows) in order. Such a key is the first of a shard, so they are few."""
    if not firsts:
        return []
    key = F.struct(*_ordered())
    few = placed.select(key.alias("key"), "shard").filter(F.array_contains(F.array(*map(_literal, firsts)), F.col("key")))
    shares: dict[Row, list[tuple[int, int]]] = {}
    for row in few.groupBy("key", "shard").agg(F.count("*").alias("n")).orderBy("shard").collect():
        shares.setdefault(row["key"], []).append((row["shard"], row["n"]))
    return [(k, shared) for k, shared in shares.items() if len(shared) > 1]


def _dealt(rows: DataFrame, key: Column, cut: list[tuple[Row, list[tuple[int, int]]]], name: str) -> DataFrame:
    """Rows of cut keys with their shard: staged, numbered per key from per-partition totals, and held against the shares."""
    which, at, first, before, held = fresh(rows.columns, "_key", "_at", "_first", "_before", "_part")
    number: Column = F.lit(None).cast("int")
    for k, (bound, _) in enumerate(cut):
        number = F.when(key == _literal(bound), F.lit(k)).otherwise(number)
    staged = Staging(rows.sparkSession, "shards-cut").write(
        rows.withColumn(which, number).withColumn(at, F.monotonically_increasing_id()), "rows"
    )
    # Several keys may share a partition: a row's place is counted among its own key there.
    part = F.shiftright(at, 33)
    inside = Window.partitionBy(which, part).orderBy(at)
    placed = staged.withColumn(first, F.row_number().over(inside) - 1)
    totals = staged.groupBy(F.col(which), part.alias(held)).agg(F.count("*").alias("_n"))
    offset = Window.partitionBy(which).orderBy(held).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(which, held, F.coalesce(F.sum("_n").over(offset), F.lit(0)).alias(before))
    joined = placed.withColumn(held, part).join(starts, [which, held])
    place = F.col(before) + F.col(first)
    shard: Column = F.lit(None).cast("int")
    for k, (_, shares) in enumerate(cut):
        upto = 0
        bounds = []
        for to, n in shares:
            upto += n
            bounds.append((upto, to))
        for end, to in reversed(bounds):
            shard = F.when((F.col(which) == k) & (place < end), F.lit(to)).otherwise(shard)
    return joined.select(*rows.columns, shard.cast("int").alias(name))


def _ordered(sizes_of: bool = False) -> list[Column]:
    """The order of the documents as columns without nulls: null doc_ids first, then by doc_id, crc32 and size."""
    text = F.col("text")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")) if sizes_of else F.col("text_crc32")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1 if sizes_of else F.col("size")
    number = F.col("doc_id").cast("bigint")
    return [
        number.isNotNull().cast("int").alias("known"),
        F.coalesce(number, F.lit(0)).alias("doc_id"),
        crc.alias("text_crc32"),
        size.alias("size"),
    ]
