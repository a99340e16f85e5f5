"""Nesting of traces of any size: a stack over blocks of spans.

`forest.nest` sorts a trace in one task.  Here spans are range-partitioned in the order of pos, within
traces too, and packed into blocks of some ten thousands, which are written once.  From the last span to the
first, a stack of starts holds what is open: its top, once what begins later is off it, is the parent, its height
the depth, and the span that takes another off it is the last one wholly before.  What a block means for the
others is small: how many spans it has, its least start, and the spans that nothing in it takes off, a chain of
ancestors.  A pass over these chains tells every block what is open at its end.  A span that a block leaves open
is finished by the block that takes it off, so that every span is made once, and only blocks are shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from buildlens.operators.shared import bound_batches, checkpoint, release

#: Spans, and bytes of them, of one block at most.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 16 << 20


def nest_in_chunks(spans: DataFrame, chunks: int | None = None, sums: bool = False, order: Sequence[str | Column] = ()) -> DataFrame:
    """As `forest.nest` (with `sums`: as `forest.build_forest`), with no trace bound to one task.

    `chunks`: how many tasks share the spans; by default as many as shuffles have.  Blocks are
    cut where a sample of the spans says, within traces too, and are written once, so that a
    lost executor cannot move their borders.  With `order`, spans come without pos and are numbered in
    this order, whose named columns are left behind.  What blocks of one trace leave open, a chain each as long
    as the trace is deep at most, meets in one task.
    """
    spark = spans.sparkSession
    bound_batches(spark)
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = LongType() if order else spans.schema["pos"].dataType
    dealt = spans.where("trace_id is not null").repartitionByRange(chunks, "trace_id", *(order or ["pos"])).sortWithinPartitions("trace_id", *(order or ["pos"]))
    dealt = dealt.drop(*[c for c in order if isinstance(c, str)])
    made = StructType([StructField(f.name, f.dataType) for f in dealt.schema])
    marks = StructType([made["trace_id"]]).add("block", LongType()).add("at", LongType()).add("n", LongType()).add("least", DoubleType()).add("data", "binary")
    if order:
        made = made.add("pos", number)
    made = made.add("first_pos", number).add("depth", IntegerType()).add("parent_pos", number).add("parent_duration", DoubleType())
    packed = checkpoint(dealt.withColumn("__part", F.spark_partition_id()).mapInArrow(_packed(BLOCK_ROWS, BLOCK_BYTES, to_arrow_schema(marks)), marks))
    del dealt, spans
    release(spark)

    opens = "block bigint, at bigint, offset bigint, first boolean, floor_pos bigint, floor_duration double, floor_depth bigint, open binary"
    found = packed.where("trace_id is not null").groupBy("trace_id").applyInArrow(_opened(bool(order)), opens)
    found = found.groupBy("block").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "block"])).alias("opens"))
    blocks = packed.where("trace_id is null").select("block", "data").repartition(chunks, "block").join(found.repartition(chunks, "block").hint("merge"), "block", "left")
    out = blocks.select("data", "opens").mapInArrow(_nested(bool(order), to_arrow_schema(made)), made)
    out = out.withColumn("end", F.col("start") + F.col("duration")).withColumn("n_descendants", F.col("pos") - F.col("first_pos"))
    return with_children_sums(out) if sums else out


def written(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def read_back(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """As doubles, null as NaN."""
    return np.asarray(column.cast(pa.float64()).to_numpy(), dtype=np.float64)


def _starts(rows: pa.Table) -> np.ndarray:
    """Starts to compare: one that is null or no number is before all."""
    starts = _numbers(rows["start"])
    return np.where(np.isnan(starts), -np.inf, starts)


def _traces(rows: pa.Table) -> list[tuple[int, int]]:
    """Where each trace of the rows begins and ends."""
    ids = rows["trace_id"].combine_chunks()
    turns = np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)) + 1
    bounds = [0, *turns.tolist(), len(ids)]
    return list(zip(bounds, bounds[1:]))


def _packed(most_rows: int, most_bytes: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of sorted spans: a row a block without trace_id, and a row for each trace that may go on beyond the block.

    The latter has where the trace begins in the block, its spans there, their least start, and those
    that none before them in the block takes off the stack, with their place (__at).
    """

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        out = [(None, number, 0, rows.num_rows, None, written(rows))]
        traces, starts = _traces(rows), _starts(rows)
        for a, b in dict.fromkeys((traces[0], traces[-1])):
            lows = np.minimum.accumulate(starts[a:b])
            left = np.flatnonzero(starts[a:b] <= lows)
            chain = rows.slice(a, b - a).take(pa.array(left)).append_column("__at", pa.array(left, pa.int64()))
            out.append((rows["trace_id"][a].as_py(), number, a, b - a, float(lows[-1]), written(chain)))
        return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size, nth, part = [], 0, 0, 0, 0

        def whole() -> pa.RecordBatch:
            return block(pa.Table.from_batches(held).drop_columns("__part").combine_chunks(), (part << 33) + nth)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, most_rows - n)
                at += piece.num_rows
                part = piece["__part"][0].as_py()
                held.append(piece)
                n, size = n + piece.num_rows, size + piece.nbytes
                if n >= most_rows or size >= most_bytes:
                    yield whole()
                    held, n, size, nth = [], 0, 0, nth + 1
        if held:
            yield whole()

    return run


def _opened(number: bool) -> Callable[[pa.Table], pa.Table]:
    """For every block of a trace, from its last to its first: what it takes off the stack, the spans left open by later blocks, and what stays below.

    The first block takes off what no block has, for nothing begins before it.
    """
    fields = [("block", pa.int64()), ("at", pa.int64()), ("offset", pa.int64()), ("first", pa.bool_()), ("floor_pos", pa.int64()), ("floor_duration", pa.float64()), ("floor_depth", pa.int64()), ("open", pa.binary())]

    def run(marks: pa.Table) -> pa.Table:
        marks = marks.sort_by("block").select(["block", "at", "n", "least", "data"]).to_pylist()
        offset = sum(m["n"] for m in marks)
        stack: list[tuple[float, int, float | None, pa.Table, int]] = []  # start, pos, duration, the chain it is of, its place there
        out = []
        for k in range(len(marks) - 1, -1, -1):
            mark = marks[k]
            offset -= mark["n"]
            cut = len(stack) if k else 0
            while cut and stack[cut - 1][0] > mark["least"]:
                cut -= 1
            taken, stack = stack[cut:], stack[:cut]
            floor = stack[-1] if stack else None
            out.append((mark["block"], mark["at"], offset, k == 0, floor and floor[1], floor and floor[2], len(stack) - 1, written(_chained(taken)) if taken else None))
            if k:
                chain = read_back(mark["data"])
                places = chain["__at"].to_numpy() + offset
                if number:
                    chain = chain.append_column("pos", pa.array(places, pa.int64()))
                stack += zip(_starts(chain).tolist()[::-1], chain["pos"].to_pylist()[::-1], chain["duration"].to_pylist()[::-1], [chain] * len(places), range(len(places) - 1, -1, -1))
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(fields)})

    return run


def _chained(taken: list[tuple[float, int, float | None, pa.Table, int]]) -> pa.Table:
    """The rows of these spans, which stand in runs of one chain."""
    parts, at = [], 0
    while at < len(taken):
        to = at
        while to < len(taken) and taken[to][3] is taken[at][3]:
            to += 1
        parts.append(taken[at][3].take(pa.array([t[4] for t in taken[at:to]])))
        at = to
    return pa.concat_tables(parts).drop_columns("__at")


def stacked(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(up, depth, first) of n spans and of those that are open behind them, which follow from the outermost to the innermost.

    up: the place of the parent, -1 for none; first: the place behind the last span that begins before, -1 if none does.
    """
    key = starts.tolist()
    up, depth, first = [-1] * len(key), [0] * len(key), [-1] * len(key)
    ids, open_ = [-1], [-np.inf]
    for j in [*range(n, len(key)), *range(n - 1, -1, -1)]:
        start = key[j]
        while open_[-1] > start:
            open_.pop()
            first[ids.pop()] = j + 1
        up[j], depth[j] = ids[-1], len(ids) - 1
        ids.append(j)
        open_.append(start)
    return np.array(up, np.int64), np.array(depth, np.int64), np.array(first, np.int64)


def _nested(number: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The spans of blocks that are finished in them."""

    def trace(rows: pa.Table, opens: dict | None) -> pa.Table:
        """opens is none for a trace that lies wholly in one block."""
        n, offset, first_block = rows.num_rows, opens["offset"] if opens else 0, not opens or opens["first"]
        if number:
            rows = rows.append_column("pos", pa.array(np.arange(offset, offset + n)))
        if opens and opens["open"] is not None:
            rows = pa.concat_tables([rows, read_back(opens["open"]).select(rows.column_names)])
        starts, durations, pos = _starts(rows), _numbers(rows["duration"]), rows["pos"].to_numpy()
        up, depth, first = stacked(starts, n)
        # one that begins inside an earlier span: a parent before it tells of the overlap
        before = np.where(first > 0, first - 1, 0)
        over = (first > 0) & (starts[before] + durations[before] > starts) if len(starts) else first > 0
        up = np.where(over, before, up)
        floor = opens is not None and opens["floor_pos"] is not None
        none = up < 0
        parent, lasts = np.where(none, opens["floor_pos"] if floor else 0, pos[up]), np.where(none, np.nan, durations[up])
        if floor:
            lasts = np.where(none, np.nan if opens["floor_duration"] is None else opens["floor_duration"], lasts)
            depth = depth + opens["floor_depth"] + 1
            none = np.zeros(len(up), bool)
        values = {"first_pos": pa.array(offset + np.maximum(first, 0)), "depth": pa.array(depth), "parent_pos": pa.array(parent, mask=none), "parent_duration": pa.array(lasts, mask=none | np.isnan(lasts))}
        for name, column in values.items():
            rows = rows.append_column(name, column.cast(schema.field(name).type))
        return rows if first_block else rows.filter(pa.array(first >= 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, opens = read_back(batch["data"][k].as_py()), {o["at"]: o for o in batch["opens"][k].as_py() or []}
                done = pa.concat_tables([trace(rows.slice(a, b - a), opens.get(a)) for a, b in _traces(rows)])
                for piece in done.select(schema.names).combine_chunks().to_batches():
                    yield pa.record_batch([c.cast(f.type) for c, f in zip(piece.columns, schema)], schema=schema)

    return run


def with_children_sums(nested: DataFrame) -> DataFrame:
    """n_children and self_duration: sums by parent are made in every task before they are shuffled."""
    inner = nested.where("parent_pos is not null").groupBy("trace_id", F.col("parent_pos").alias("pos")).agg(F.count("*").cast("int").alias("n_children"), F.sum("duration").alias("__inner"))
    out = nested.join(inner, ["trace_id", "pos"], "left")
    return out.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("self_duration", F.col("duration") - F.coalesce("__inner", F.lit(0.0))).drop("__inner")
