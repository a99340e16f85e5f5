"""How far a stream of jobs is, and stopping work that is no longer wanted."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRIC = "finished_jobs"


def counted(jobs: DataFrame) -> DataFrame:
    """`jobs`, a row a finished job, with their number told to listeners as batches end."""
    return jobs.observe(METRIC, F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Calls `tell(done, total)` whenever a batch of a query over `counted` jobs has ended; restarted queries go on from `done`."""

    def __init__(self, total: int, tell: Callable[[int, int], None], done: int = 0):
        self.total, self.tell, self.done = total, tell, done
        self.failed: str | None = None
        self._batches: set[tuple[str, int]] = set()
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = (event.progress.observedMetrics or {}).get(METRIC)
        batch = (str(event.progress.id), event.progress.batchId)
        with self._lock:
            if found is None or batch in self._batches:
                return
            self._batches.add(batch)
            self.done += found["n"]
            self.tell(self.done, self.total)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failed = event.exception


@contextmanager
def watched(spark: SparkSession, progress: Progress) -> Iterator[Progress]:
    spark.streams.addListener(progress)
    try:
        yield progress
    finally:
        spark.streams.removeListener(progress)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], None]]:
    """Jobs of the thread inside can be stopped by what this gives, from any thread: their tasks end, and what they began to write is taken back.

    A session's own tags are known only to the thread that set them, so the context's are used.
    """
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        yield lambda: context.cancelJobsWithTag(tag)
    finally:
        context.removeJobTag(tag)


def stop_all(spark: SparkSession) -> None:
    """Stop every stream of the session; each goes on from its checkpoint when started again."""
    for query in spark.streams.active:
        query.stop()
