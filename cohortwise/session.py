"""Session settings the library is written for, and the shared folder it may write to."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# AQE sizes the shuffle, splits skewed join partitions and picks broadcast joins from
# measured sizes, so no operator hints a broadcast of something that can grow.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # state of any size, and the only store that holds the states of custom processors
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "cohortwise", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the recommended settings; `conf` keys use `_` for `.`.

    On a cluster give `spark_sql_shuffle_partitions` for the largest shuffle (its bytes over
    200 MB); AQE merges what turns out small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: `spark.checkpoint.dir` where the cluster sets it.

    A session on one machine without that setting gets a folder beside its warehouse, which becomes its
    checkpoint folder. A cluster session without it is refused, because a machine-local
    folder would be lost with the machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared/{context.applicationId}"
    context.setCheckpointDir(folder)
    return folder


#: Rows of the largest input table to a partition that a shuffle starts with.
ROWS = 100_000
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_set: set[str] = set()
#: Bytes of files to a task that reads them, in place of Spark's default: prepared tables shrink more than tenfold in Parquet.
READ, READ_DEFAULT, READ_BYTES = "spark.sql.files.maxPartitionBytes", ("134217728b", "128MB", "128m"), "32m"
#: Bytes of a shuffle to a task that AQE merges partitions up to, in place of Spark's default: rows that come from sorted
#: tables take up to sixty times as much when a join sorts them.
MERGE, MERGE_DEFAULT, MERGE_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", ("67108864b", "64MB", "64m"), "16m"


def start_wide(spark: SparkSession, rows: int) -> int | None:
    """Let shuffles start with a partition for each ROWS of `rows`, and return their number, None if one is enough.

    With a fixed number of partitions each task's sort or aggregate grows with the input until it spills; AQE merges
    partitions that turn out small. The session's own number is the least, and its own initial number stays. Tasks that
    read files or merged partitions get smaller pieces, unless the session has set the size.
    """
    if spark.conf.get(READ) in READ_DEFAULT:
        spark.conf.set(READ, READ_BYTES)
    if spark.conf.get(MERGE, MERGE_DEFAULT[0]) in MERGE_DEFAULT:
        spark.conf.set(MERGE, MERGE_BYTES)
    parts = -(-rows // ROWS)
    current = spark.conf.get(INITIAL, None)
    if current is None or current in _set:
        wanted = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts))
        _set.add(wanted)
        spark.conf.set(INITIAL, wanted)
    return max(parts, spark.sparkContext.defaultParallelism) if parts > 1 else None
