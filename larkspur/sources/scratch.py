"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

#: Bytes of scanned files for each task of a shuffle that dealt() makes, and the most tasks.
TASK_BYTES, MOST_PARTS = 4 << 20, 100_000


def scratch_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a local master gets a folder made here, and a cluster an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows, written once as Parquet and read back: later jobs see the same rows, and what is behind isn't run again."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(*dfs: DataFrame) -> int:
    """How many tasks hold TASK_BYTES each of what the plans scan; 0 if that is no more than there are cores, or if the sizes aren't known: then Spark deals, as little goes to a task anyway.

    Left to itself, Spark puts up to spark.sql.adaptive.advisoryPartitionSizeInBytes of compressed rows in a task, so a task that sorts and groups them grows with the tables until then.
    """
    total = 0
    for df in dfs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
        total += sum(b for b in sizes if b < 1 << 60)  # rows that are not in files have no size
    n, spark = min(MOST_PARTS, total // TASK_BYTES + 1), dfs[0].sparkSession
    # with fewer than spark.sql.shuffle.partitions, Spark may deal once more for a join
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > spark.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, parts: int, *columns: str | Column) -> DataFrame:
    """df by the hashes of the columns in so many parts, or (0) as it is."""
    return df.repartition(parts, *columns) if parts else df
