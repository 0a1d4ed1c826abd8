"""Which message ids have been seen: exact sets of 64-bit ids that are small on disk and can be united.

Ids are grouped into buckets of 32,768 consecutive numbers. A bucket that holds ``DENSE`` of them or more is a bitmap of
4 KB, the ids of the others stay a sorted list, so an index never takes more than the ids themselves and takes an eighth
of a byte an id where ids are consecutive. Both parts of several indexes are united by aggregations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.session import stage

#: A bitmap takes 4,096 bytes, so many ids of 8 bytes do as well.
DENSE = 512
DENSE_SCHEMA = "bucket bigint, bits binary"
SPARSE_SCHEMA = "message_id bigint"


@dataclass(frozen=True)
class IdIndex:
    """``dense``: (bucket, bits), one row per bucket and united index; ``sparse``: (message_id), in no bitmap."""

    dense: DataFrame
    sparse: DataFrame


def index_ids(ids: DataFrame, col: str = "message_id", dense: int = DENSE) -> IdIndex:
    """The index of the ids that are not null; repeated ones count once.

    A bucket has 32,768 different ids at most, whatever the input. The buckets are staged, since both parts read them.
    """
    named = ids.select(F.col(col).cast("bigint").alias("message_id")).filter(F.col("message_id").isNotNull()).distinct()
    bucket = F.bitmap_bucket_number("message_id").alias("bucket")
    grouped = named.groupBy(bucket).agg(
        F.count("*").alias("n"),
        F.bitmap_construct_agg(F.bitmap_bit_position("message_id")).alias("bits"),
        F.sort_array(F.collect_list("message_id")).alias("ids"),
    )
    few = F.col("n") < dense
    buckets = stage(
        grouped.select("bucket", F.when(~few, F.col("bits")).alias("bits"), F.when(few, F.col("ids")).alias("ids")), "buckets"
    )
    return IdIndex(
        buckets.filter("bits IS NOT NULL").select("bucket", "bits"),
        buckets.filter("ids IS NOT NULL").select(F.explode("ids").alias("message_id")),
    )


def united(indexes: list[IdIndex]) -> IdIndex:
    """One index of the ids of all. Bitmaps of a bucket are united when the index is asked, see :func:`marked`."""
    return IdIndex(
        reduce(DataFrame.unionByName, [i.dense for i in indexes]), reduce(DataFrame.unionByName, [i.sparse for i in indexes])
    )


def _bit(bits: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set; null for no bitmap."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def marked(messages: DataFrame, index: IdIndex, out: str = "_written") -> DataFrame:
    """Add whether ``message_id`` is in the index; a null id is in none.

    Messages meet one row per bucket and, in another join, the ids that are in no bitmap. A bucket holds a bounded number
    of different ids; united bitmaps are staged so that adaptive execution can split messages that repeat one.
    """
    bits = stage(index.dense.groupBy(F.col("bucket").alias("_bucket")).agg(F.bitmap_or_agg("bits").alias("_bits")), "bitmaps")
    single = index.sparse.distinct().withColumn("_single", F.lit(True))
    known = stage(single, "single-ids")
    columns = messages.columns
    rows = messages.withColumn("_bucket", F.bitmap_bucket_number("message_id"))
    joined = rows.join(bits, "_bucket", "left").join(known, "message_id", "left")
    held = _bit(F.col("_bits"), F.bitmap_bit_position("message_id"))
    found = F.coalesce(held, F.lit(False)) | F.coalesce(F.col("_single"), F.lit(False))
    return joined.select(*[F.col(c) for c in columns], found.alias(out))


def drop_indexed(messages: DataFrame, index: IdIndex) -> DataFrame:
    """Messages whose id is not in the index: the rows of ``drop_existing``, without reading an earlier message."""
    return marked(messages, index).filter(~F.col("_written")).drop("_written")
