"""Unit profiles while jobs run: process trees a tick, peaks, and a row when a job has ended.

A sample is one process at one time: job, ts, pid, ppid, rss, and whether it is the job's root.  A row
with a null pid marks the end of its job.  What the processes below the root use together at a tick
counts; the greatest of these sums is the job's peak.

The stream keeps, for every job that runs, the processes of ticks that late samples may still reach,
and three numbers.  A tick is settled by a timer when the watermark has passed it; the job's row goes
out when its end is settled, or when nothing came of it for `idle`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from buildlens.operators.forest import process_trees

SAMPLES = "job string, ts timestamp, pid bigint, ppid bigint, rss bigint, root boolean"
PROFILE = "job string, max_rss bigint, n_ticks bigint, first_tick bigint, last_tick bigint, ended boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tree_rss(processes: list[tuple[int, int, int, bool]]) -> int | None:
    """Sum of rss of the processes (pid, ppid, rss, root) at or below a root; None without a root."""
    below: dict[int, list[int]] = {}
    rss: dict[int, int] = {}
    for pid, ppid, used, _ in processes:
        rss[pid] = used
        if pid != ppid:
            below.setdefault(ppid, []).append(pid)
    todo = [pid for pid, _, _, root in processes if root]
    seen = set(todo)
    while todo:
        for pid in below.get(todo.pop(), ()):
            if pid not in seen:
                seen.add(pid)
                todo.append(pid)
    return sum(rss[p] for p in seen) if seen else None


def tick_of(tick_ms: int):
    return F.floor(F.unix_millis("ts") / tick_ms).cast("bigint")


def batch_profiles(samples: DataFrame, tick_ms: int = 50) -> DataFrame:
    """The profiles of stored samples: job, max_rss, n_ticks, first_tick, last_tick, ended.

    Of a process that is sampled twice in a tick the last sample counts.  A job of which no tick has
    a root has no row.
    """
    rows = samples.withColumn("tick", tick_of(tick_ms))
    last = Window.partitionBy("job", "tick", "pid").orderBy(F.desc("ts"), F.desc("rss"))
    live = rows.where("pid is not null").withColumn("__n", F.row_number().over(last)).where("__n = 1")
    trees = process_trees(live, live.where("root"), ["job", "tick"])
    ticks = live.join(trees, ["job", "tick", "pid"], "left_semi").groupBy("job", "tick").agg(F.sum("rss").alias("rss"))
    ends = rows.where("pid is null").select("job").distinct().withColumn("ended", F.lit(True))
    sums = ticks.groupBy("job").agg(F.max("rss").alias("max_rss"), F.count("*").alias("n_ticks"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))
    return sums.join(ends, "job", "left").withColumn("ended", F.coalesce("ended", F.lit(False)))


class JobProfiles(StatefulProcessor):
    """State of a job: open ticks' processes; peak, first and last tick, count, end."""

    def __init__(self, tick_ms: int, idle_ms: int):
        self.tick_ms, self.idle_ms = tick_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "tick bigint, pid bigint", "ts bigint, ppid bigint, rss bigint, root boolean")
        self.peak = handle.getValueState("peak", "max_rss bigint, n_ticks bigint, first_tick bigint, last_tick bigint, end_ms bigint, seen_ms bigint")

    def _peak(self) -> list:
        return list(self.peak.get()) if self.peak.exists() else [None, 0, None, None, None, 0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, timers = self._peak(), set()
        for frame in rows:
            for ms, pid, ppid, rss, root in zip(frame["ms"], frame["pid"], frame["ppid"], frame["rss"], frame["root"]):
                ms = int(ms)
                tick = ms // self.tick_ms
                state[5] = max(state[5], ms)
                if pd.isna(pid):
                    state[4] = max(state[4] or 0, ms)
                    timers.add(ms + 1)
                    continue
                at = (tick, int(pid))
                new = (ms, int(ppid), int(rss), bool(root))
                if not self.open.containsKey(at) or tuple(self.open.getValue(at))[0::2] <= new[0::2]:
                    self.open.updateValue(at, new)
                timers.add((tick + 1) * self.tick_ms)
        timers.add(state[5] + self.idle_ms)
        self.peak.update(tuple(state))
        for at in timers:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.peak.exists():
            return
        now, state = timerValues.getCurrentWatermarkInMs(), self._peak()
        done: dict[int, list[tuple[int, int, int, bool]]] = {}
        for (tick, pid), (_, ppid, rss, root) in list(self.open.iterator()):
            if (tick + 1) * self.tick_ms <= now:
                done.setdefault(tick, []).append((pid, ppid, rss, root))
        for tick, processes in done.items():
            for pid, *_ in processes:
                self.open.removeKey((tick, pid))
            if (used := tree_rss(processes)) is not None:
                state = [max(state[0] or 0, used), state[1] + 1, min(tick, state[2] if state[2] is not None else tick), max(tick, state[3] if state[3] is not None else tick), *state[4:]]
        ended = state[4] is not None and state[4] < now
        if (ended or state[5] + self.idle_ms <= now) and not any(True for _ in self.open.keys()):
            if state[1]:
                yield pd.DataFrame([(key[0], *state[:4], ended)], columns=[f.split(" ")[0] for f in PROFILE.split(", ")])
            self.peak.clear()
        else:
            self.peak.update(tuple(state))
            if ended:  # its last ticks are not settled yet
                self.handle.registerTimer(max(t for t, _ in self.open.keys()) * self.tick_ms + self.tick_ms)


def stream_profiles(samples: DataFrame, tick_ms: int = 50, late: str = "1 second", idle_ms: int = 3_600_000) -> DataFrame:
    """As batch_profiles, of a stream: a row a job when it has ended, appended once.

    Samples later than `late` are dropped.  A job that is silent for `idle_ms` without an end gets
    its row with ended false.  State needs the RocksDB store, which this sets for the session.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = samples.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("job").transformWithStateInPandas(JobProfiles(tick_ms, idle_ms), PROFILE, "Append", "EventTime")


def write_batches(stream: DataFrame, path: str, checkpoint: str, **options):
    """Append a stream's batches under `path`, each once: a batch has a folder by its number, so that one replayed after a crash replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    options = options or {"availableNow": True}
    return stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**options).start()


def read_batches(spark: SparkSession, path: str, schema: str = PROFILE) -> DataFrame:
    """What write_batches has appended so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
