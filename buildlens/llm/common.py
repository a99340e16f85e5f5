"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass handles; larger Arrow batches are sliced.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes: documents may be very long."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(key, value)


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the checkpoint folder that the cluster names; only without one (tests) make a local one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="buildlens-checkpoints-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def sized_anew(df: DataFrame) -> DataFrame:
    """A checkpointed frame without the size that was estimated for the plan behind it.

    Estimates of joins are products, and checkpoints hand them on: in a loop of joins they grow to
    numbers of millions of digits, which the planner then multiplies.
    """
    spark, frame = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(frame.toJavaRDD(), frame.schema()), spark)


def release(spark: SparkSession) -> None:
    """Let the cleaner remove shuffle files that nothing refers to any more: behind a large checkpoint they only fill disks.

    Handles that Python lets go in the first round are gone for the second.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `most` bytes of text each, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(text))
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    done = np.cumsum(size)
    at = 0
    while at < n:
        base = done[at] - size[at]
        to = max(at + 1, int(np.searchsorted(done, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def list_binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Fixed-width values as one binary cell a row: row i holds values[offsets[i]:offsets[i+1]]."""
    width = values.dtype.itemsize
    offs = np.asarray(offsets, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def binary_values(col: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of list_binary: (values, offsets)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    buffers = col.buffers()
    offs = np.frombuffer(buffers[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2], dtype=np.uint8)[offs[0] : offs[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    width = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype=dtype), (offs - offs[0]) // width


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by the key columns.

    Rows of the last group of a batch wait for the next batch, so a table never
    ends inside a group; memory holds one batch and one group.
    """
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        n = t.num_rows
        same = np.ones(n, dtype=bool)
        for k in keys:
            v = t[k].to_numpy()
            same &= v == v[-1]
        first = n - int(same[::-1].argmin()) if not same.all() else 0
        if first:
            yield t.slice(0, first).combine_chunks()
        held = t.slice(first)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def boundaries(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Offsets of the groups of a sorted table."""
    n = t.num_rows
    edge = np.zeros(n, dtype=bool)
    if n:
        edge[0] = True
    for k in keys:
        v = t[k].to_numpy()
        edge[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(edge), n)
