"""A store of batches that survives a run that breaks off.

::

    data/run=<folder>/batch=<n>/        the messages of a run
    ids/run=<folder>/, single_ids/...   the index of their ids (operators.membership)
    summaries/run=<folder>/, counties/  statistics per batch (operators.sketches)
    commits/run=<number>/               batches and row counts of the run, as read back from what was written

A run writes into folders of its own, whose names no other run uses, and its commit record last. Readers look at the
commit records first and read the folders that these name, so of a run that broke off nothing is ever seen: the next run
finds the same messages to be new, gives them the same batch numbers and writes them into other folders. A record is one
file, which a writer's commit puts in place by a rename. Two runs at a time would take the same number, and the second
record is refused.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel import schemas
from weekpanel.operators import membership, sketches
from weekpanel.operators.batches import batch_summary
from weekpanel.sources import writers

COMMIT_SCHEMA = "number bigint, folder string, batch bigint, messages bigint, user_weeks bigint"
SAMPLED_BATCH = T.StructType([*schemas.SAMPLED.fields, T.StructField("batch", T.LongType(), True)])


class Deliveries:
    """The store at ``path``, which need not exist yet."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- what has been committed ------------------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        """One row per batch of a committed run; a run without batches has a row with nulls."""
        found = self._read("commits", COMMIT_SCHEMA)
        return self._empty(COMMIT_SCHEMA) if found is None else found.select("number", "folder", "batch", "messages", "user_weeks")

    def folders(self) -> list[str]:
        """The folders of committed runs in their order: one short text per run on the driver."""
        rows = self.commits().select("number", "folder").distinct().orderBy("number").collect()
        return [r["folder"] for r in rows]

    def summary(self) -> DataFrame:
        """Messages and user-weeks per batch, from the records alone."""
        return self.commits().filter("batch IS NOT NULL").select("batch", "messages", "user_weeks")

    def next_batch(self) -> int:
        """The number after the largest committed batch, 0 when there is none."""
        return self.commits().agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]

    def messages(self) -> DataFrame:
        """All committed messages with their ``batch``."""
        return self._committed("data", SAMPLED_BATCH)

    def ids(self) -> membership.IdIndex:
        """The index of all committed message ids."""
        return membership.IdIndex(
            self._committed("ids", membership.DENSE_SCHEMA), self._committed("single_ids", membership.SPARSE_SCHEMA)
        )

    def statistics(self, batches: list[int] | None = None) -> DataFrame:
        """Messages, user-weeks, users and counties of the given batches, or of all, in one row; no message is read."""
        parts = (
            self._committed("summaries", sketches.SUMMARY_SCHEMA),
            self._committed("counties", sketches.COUNTY_SCHEMA),
        )
        if batches is not None:
            parts = tuple(p.filter(F.col("batch").isin(list(batches))) for p in parts)
        return sketches.united_statistics(*parts)

    # -- a run ------------------------------------------------------------------------------------------------------

    def write(self, members: DataFrame) -> DataFrame:
        """Write the messages with their ``batch`` as one run and commit it; the summary of its batches.

        Counts, ids and statistics are taken from the files that were written, with the columns they need.
        """
        number = self.commits().agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
        folder = f"{number:06d}-{uuid.uuid4().hex}"
        writers.write_batches(members, self.folder_of(folder, "data"), mode="error")
        written = self.spark.read.schema(SAMPLED_BATCH).parquet(self.folder_of(folder, "data"))
        index = membership.index_ids(written)
        index.dense.write.parquet(self.folder_of(folder, "ids"))
        index.sparse.write.parquet(self.folder_of(folder, "single_ids"))
        sketches.summarised(written).write.parquet(self.folder_of(folder, "summaries"))
        sketches.county_bitmaps(written).write.parquet(self.folder_of(folder, "counties"))
        self._commit(number, folder, batch_summary(written))
        return self.summary().join(self._batches_of(number), "batch", "left_semi")

    def _commit(self, number: int, folder: str, summary: DataFrame) -> None:
        """One row per batch, and one in any case, as one file."""
        run = self.spark.createDataFrame([(number, folder)], "number bigint, folder string")
        counts = summary.select("batch", "messages", "user_weeks")
        record = run.join(counts, F.lit(True), "left").select("number", "folder", "batch", "messages", "user_weeks")
        record.coalesce(1).write.mode("error").parquet(f"{self.path}/commits/run={number:06d}")

    def abandoned(self) -> list[str]:
        """Folders of runs that never committed. A run that is still going on is among them."""
        found = self._read("data", "run string, batch bigint")
        if found is None:
            return []
        names = found.select("run").distinct().collect()  # one short text per run
        return sorted({r["run"] for r in names} - set(self.folders()))

    def remove_abandoned(self) -> list[str]:
        """Delete what :meth:`abandoned` names. Only for a time when no run is going on."""
        folders = self.abandoned()
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in folders:
            for part in ("data", "ids", "single_ids", "summaries", "counties"):
                target = jvm.org.apache.hadoop.fs.Path(self.folder_of(folder, part))
                target.getFileSystem(conf).delete(target, True)
        return folders

    # -- paths ------------------------------------------------------------------------------------------------------

    def folder_of(self, folder: str, part: str) -> str:
        return f"{self.path}/{part}/run={folder}"

    def _batches_of(self, number: int) -> DataFrame:
        return self.commits().filter(F.col("number") == number).select("batch")

    def _committed(self, part: str, schema: str | T.StructType) -> DataFrame:
        folders = self.folders()
        if not folders:
            return self._empty(schema)
        empty = self._empty(schema)
        reader = self.spark.read.schema(empty.schema).option("basePath", f"{self.path}/{part}")
        return reader.parquet(*[self.folder_of(f, part) for f in folders]).select(*empty.columns)

    def _read(self, part: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _empty(self, schema: str | T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)
