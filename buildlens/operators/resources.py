"""Memory samples of jobs: peaks, memory that was newly used, and which jobs had to yield."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that stay free for every job that runs, before anything is known.
MARGIN_PER_JOB = 100_000_000


def tick_totals(samples: DataFrame) -> DataFrame:
    """(job, tick, rss): what the processes of a job use together at a tick."""
    return samples.groupBy("job", "tick").agg(F.sum("rss").alias("rss"))


def max_rss(samples: DataFrame) -> DataFrame:
    """(job, max_rss, n_ticks): the peak of each job.  Both aggregations are partial before their shuffle."""
    return tick_totals(samples).groupBy("job").agg(F.max("rss").alias("max_rss"), F.count("*").alias("n_ticks"))


def unit_profiles(samples: DataFrame, tick_s: float = 0.05) -> DataFrame:
    """(file, max_rss, time) of finished jobs."""
    ticks = tick_totals(samples).groupBy("job").agg(F.max("rss").alias("max_rss"), F.max("tick").alias("last"), F.min("tick").alias("first"))
    return ticks.select(F.col("job").alias("file"), "max_rss", ((F.col("last") - F.col("first")) * tick_s).cast("float").alias("time"))


def newly_used(ticks: DataFrame, by: list[str], order: str, available: str = "available_memory") -> DataFrame:
    """`ticks` with newly_used: how much less memory is available than a tick before, 0 at least."""
    w = Window.partitionBy(*by).orderBy(order)
    gone = F.lag(available).over(w) - F.col(available)
    return ticks.withColumn("newly_used", F.greatest(F.coalesce(gone, F.lit(0)), F.lit(0)))


def elapsed_ticks(samples: DataFrame) -> DataFrame:
    """`samples` with elapsed: ticks since a worker began its job, from 1."""
    w = Window.partitionBy("worker", "job").orderBy("tick")
    return samples.withColumn("elapsed", F.row_number().over(w))


def youngest(active: DataFrame, by: list[str]) -> DataFrame:
    """The worker to stop in each group: least elapsed, the first on ties."""
    return active.groupBy(*by).agg(F.min_by("worker", F.struct("elapsed", "worker")).alias("worker"))


def initial_margin(workers: Column | int, background: int = 1) -> Column:
    return (F.lit(workers) if isinstance(workers, int) else workers) * MARGIN_PER_JOB + background * MARGIN_PER_JOB


def active_workers(word: Column) -> Column:
    """How many flags of a bit set are set."""
    return F.bit_count(word)


def slower_poll(interval_ms: Column, took_ms: Column) -> Column:
    """The polling interval after a round: unchanged if the round was in time, else a tenth more than it took."""
    return F.when(took_ms > interval_ms, F.ceil(took_ms * 11 / 10)).otherwise(interval_ms)


def adaptive_margin(ticks: DataFrame, by: list[str], order: str, threads: int, background: int = 1, used: str = "newly_used") -> DataFrame:
    """`ticks` with margin: bytes to keep free at each tick, while the number of threads stays.

    It begins at MARGIN_PER_JOB for each thread.  Where a tick uses more than the margin, what it
    used a thread, rounded up beyond it, is kept free for each from then on.  As a margin only
    rises, this is the greatest so far, a window.
    """
    all_threads = threads + background
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = (F.floor(F.col(used) / all_threads) + 1) * all_threads
    first = F.lit(all_threads * MARGIN_PER_JOB).cast("bigint")
    return ticks.withColumn("margin", F.greatest(first, F.max(F.when(F.col(used) > first, need)).over(w).cast("bigint")))
