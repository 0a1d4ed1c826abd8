"""Session settings, and staged tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
MOST_REDUCERS = 20_000
_LOCAL_FOLDERS: dict[str, str] = {}
_SHARED_FOLDERS: dict[tuple[str, str | None], str] = {}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Run-time re-planning: coalesce small reducers, split hot ones in joins and rebalanced writes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key in a join even if what follows could otherwise have reused the join's partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # The planner broadcasts a side only when its measured size is below this; otherwise it shuffles.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # A compressed file is taken to be three times its size in memory when it is held against that threshold.
    "spark.sql.sources.fileCompressionFactor": "3.0",
    # Bloom filters from a selective join side drop rows of the large side before it is shuffled.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Batches sent to Python hold embeddings of 1,024 doubles: 2,000 rows are 16 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Mean vectors are hashed by group on the map side up to so many groups a task, then sorted: at 1,024 components a
    # group takes some 24 KB, so 100 MB in all. Spark's own limit of 128 groups would sort all vectors of a task.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # Timestamps are written as they are, without a calendar rebase.
    "spark.sql.parquet.int96RebaseModeInWrite": "CORRECTED",
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
}


def configure(builder: SparkSession.Builder, shuffled_bytes: int | None = None) -> SparkSession.Builder:
    """Apply :data:`SETTINGS`; with the size of the widest shuffle, also set its number of reducers."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    if shuffled_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions(shuffled_bytes)))
    return builder


def apply(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session, leaving alone what its own configuration names."""
    given = spark.sparkContext.getConf()
    for name, value in SETTINGS.items():
        if not given.contains(name):
            spark.conf.set(name, value)
    return spark


def shuffle_partitions(
    shuffled_bytes: int, target_bytes: int = 2**30, least: int = 8, most: int = MOST_REDUCERS
) -> int:
    """Number of reducers that keeps each near ``target_bytes`` of shuffled data (not of input).

    Adaptive execution merges the ones that end up small. Beyond ``most`` reducers grow instead, and spill: every
    map task reports a size for each reducer to the driver, which cannot hold hundreds of thousands of either.
    """
    return min(most, max(least, math.ceil(shuffled_bytes / target_bytes)))


def use_corrected_timestamps(spark: SparkSession) -> None:
    """Write Parquet timestamps without the legacy calendar rebase."""
    spark.conf.set("spark.sql.parquet.int96RebaseModeInWrite", "CORRECTED")
    spark.conf.set("spark.sql.parquet.datetimeRebaseModeInWrite", "CORRECTED")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one that the session names in ``spark.checkpoint.dir``, else the warehouse.

    A session on one machine that names none gets a temporary folder, under its real path: executors may have a
    temporary folder of their own, and a name such as ``/proc/self/cwd`` leads each process elsewhere. On a cluster a
    folder with a ``file:`` path may be a mount that all machines share, or one of each machine's own, in which every
    executor would write to its own disk and readers would see a part without an error. The path does not tell, so a
    small table is written there once per application. If rows are missing the warehouse is tried in the same way, and
    only if that loses rows too there is an error.
    """
    context = spark.sparkContext
    one_machine = context.master.startswith("local")  # local-cluster, for tests, is one machine as well
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if one_machine:
        if named:
            return named.rstrip("/")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = os.path.realpath(tempfile.mkdtemp(prefix="weekpanel-"))
        return _LOCAL_FOLDERS[context.applicationId]
    key = (context.applicationId, named)
    if key not in _SHARED_FOLDERS:
        _SHARED_FOLDERS[key] = _first_shared(spark, [f for f in (named, spark.conf.get("spark.sql.warehouse.dir")) if f])
    return _SHARED_FOLDERS[key]


def _first_shared(spark: SparkSession, folders: list[str]) -> str:
    refused = []
    for folder in (f.rstrip("/") for f in folders):
        try:
            if file_system(spark, folder) == "file":
                require_shared(spark, folder)
            return folder
        except ValueError as error:
            refused.append(error)
    raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: {'; '.join(map(str, refused))}") from refused[0]


def require_shared(spark: SparkSession, folder: str) -> None:
    """Raise an error unless all rows that tasks write to ``folder`` are there for the driver and for other tasks."""
    context = spark.sparkContext
    tasks = 2 * context.defaultParallelism
    path = f"{folder}/weekpanel-{context.applicationId}/shared-{uuid.uuid4().hex}"
    own = f"{folder} is a folder of each machine's own"
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        rows = spark.read.schema("id long").parquet(path).count()
    except Exception as error:
        raise ValueError(own) from error
    if rows != tasks:
        raise ValueError(own)


def file_system(spark: SparkSession, path: str) -> str:
    """The scheme of the file system that a path belongs to, the default one if it names none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()


def small_side(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side rows as the small side of an equi-join: broadcast up to ``BROADCAST_ROWS``, shuffled beyond."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and go on from the written table.

    Used where several branches read the same expensive rows, where row positions must not change between two
    reads, and for the small side of a join on a key that may be hot. In the last case it is an aggregate by
    that very key which must be staged: the join would otherwise reuse the aggregate's partitioning, and
    adaptive execution splits a hot key only where both sides of the join come straight from a shuffle.

    Unlike a cache a staged table survives the loss of executors, and unlike a checkpointed RDD its readers
    still prune columns. All tables of an application lie in one folder, so they can be expired together.
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/weekpanel-{application}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
