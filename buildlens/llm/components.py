"""Connected components of an edge table, by joins and aggregations of edges that tasks have contracted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import checkpoint, release, sized_anew

MAX_ROUNDS = 60
#: Edges that a task contracts at once, 16 bytes each; more are shared by more tasks.
EDGES_A_TASK = 1 << 18


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the least id of each one's component) of the given edges."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != (up := label[label])).any():
            label = up
    return ids, ids[label]


def _contract(most: int):
    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, least = least_labels(t["a"].to_numpy(), t["b"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], names=["id", "comp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if held and rows + batch.num_rows > most:
                yield stars(held)
                held, rows = [], 0
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield stars(held)

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id on an edge; comp is the least id of its component.

    `edges` has BIGINT columns a and b; loops, repeats and nulls do no harm.  First every task
    turns its edges, a bounded number at once, into stars round the least ids; edges that fit a
    single task are done with that.  Then every
    round takes the least label among the neighbours and then jumps to the label's
    own label, so a path of length n takes about log n rounds.  Labels are
    aggregated map-side before each shuffle; nothing is collected but one flag.  The shuffle
    files of earlier rounds are freed in every third, so that disks don't fill with rounds.
    """
    edges = sized_anew(checkpoint(edges.where("a is not null and b is not null").select("a", "b")))
    tasks = -(-edges.count() // EDGES_A_TASK)
    stars = sized_anew(checkpoint(edges.coalesce(max(tasks, 1)).mapInArrow(_contract(EDGES_A_TASK), "id bigint, comp bigint")))
    if tasks <= 1:
        return stars
    both = stars.select("id", F.col("comp").alias("other"))
    both = sized_anew(checkpoint(both.union(both.select("other", "id")).distinct()))
    labels = checkpoint(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("comp")))
    for k in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("comp").alias("m"))
        better = labels.join(near, "id").select("id", "comp", F.least("comp", "m").alias("now"))
        parent = labels.select(F.col("id").alias("now"), F.col("comp").alias("up"))
        moved = checkpoint(better.join(parent, "now", "left").select("id", F.least("now", F.coalesce("up", "now")).alias("new"), "comp"))
        changed = not moved.where("new < comp").isEmpty()
        if not changed or k % 3 == 2:
            moved = sized_anew(moved)
            del near, better, parent, labels
            release(moved.sparkSession)
        labels = moved.select("id", F.col("new").alias("comp"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
