"""Cutting lineage in the shared checkpoint folder, and numbering rows."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir; a local session may go without and gets one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="buildlens-checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the cleaner remove shuffle files that nothing refers to any more: behind a checkpoint they only fill disks.

    Handles that Python lets go in the first round are gone for the second.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Bytes of an Arrow batch: rows that hold documents or packed spans are large.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Rows of spans that one task sorts, a few hundred bytes each in all its windows: half a gigabyte at most.
ROWS_A_TASK = 1 << 18


def tasks_for(spark: SparkSession, *tables: DataFrame) -> int:
    """How many tasks share all rows of `tables`: in proportion to them, so that what one task holds stays the same."""
    rows = sum(t.count() for t in tables)
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """`df` with a dense number from 0 in the given order of all rows; equal rows in any order.

    Rows are range-partitioned and sorted; the partitions' sizes, a number each, give where
    their counts begin.  The sorted rows are written once, so that both passes see the same.
    """
    ordered = checkpoint(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = sorted((r["__part"], r["n"]) for r in ordered.groupBy("__part").agg(F.count("*").alias("n")).collect())
    shift, done = [], 0
    for part, n in sizes:
        shift.append((part, done - (part << 33)))  # ids of a partition begin at its number times 2 ** 33
        done += n
    begins = F.broadcast(df.sparkSession.createDataFrame(shift, "__part int, __shift bigint"))  # a row a partition
    return ordered.join(begins, "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")
