"""Streams of jobs: profiles with state, batches that are written once, progress, and stopping."""

import random
import threading
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from buildlens.streaming import jobs
from buildlens.streaming.progress import Progress, cancellable, counted, stop_all, watched

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(ms):
    return START + timedelta(milliseconds=ms)


def job_samples(rng, job, begin):
    """Samples of a job whose processes come and go, and its end."""
    rows, ms, pids = [], begin, {1: 0}
    for _ in range(rng.randrange(2, 9)):
        if rng.random() < 0.6:
            new = max(pids) + 1
            pids[new] = rng.choice([*pids, 77])  # 77 is nobody's
        if len(pids) > 2 and rng.random() < 0.3:
            del pids[rng.choice([p for p in pids if p > 1])]
        rows += [(job, at(ms + rng.randrange(20)), p, up, rng.randrange(1, 1000), p == 1) for p, up in pids.items()]
        ms += rng.choice([50, 50, 100, 250])
    return [*rows, (job, at(ms), None, None, None, None)]


def write(spark, folder, k, rows):
    spark.createDataFrame(rows, jobs.SAMPLES).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder):
    stream = spark.readStream.schema(jobs.SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.write_batches(jobs.stream_profiles(stream, 50, "5 seconds", 100_000), f"{folder}/out", f"{folder}/cp").awaitTermination()


def test_profiles_with_state_equal_stored_ones(spark, tmp_path):
    rng = random.Random(6)
    rows = [r for k in range(12) for r in job_samples(rng, f"j{k}", rng.randrange(0, 1500))]
    rows += [("never rooted", at(300), 5, 4, 9, False), ("never rooted", at(400), None, None, None, None), ("silent", at(100), 1, 0, 50, True), ("twice", at(110), 1, 0, 5, True), ("twice", at(120), 1, 0, 3, True), ("twice", at(200), None, None, None, None)]
    rng.shuffle(rows)
    (tmp_path / "in").mkdir()
    half = len(rows) // 2
    for k in range(0, half, 25):
        write(spark, tmp_path, k, rows[k : min(k + 25, half)])
    run(spark, tmp_path)
    for k in range(half, len(rows), 25):  # the query goes on from its checkpoint
        write(spark, tmp_path, k, rows[k : k + 25])
    run(spark, tmp_path)
    for ms in (10_000, 300_000, 300_001):
        write(spark, tmp_path, ms, [("clock", at(ms), 1, 0, 1, True)])
        run(spark, tmp_path)
    got = sorted(map(tuple, jobs.read_batches(spark, f"{tmp_path}/out").where("job <> 'clock'").collect()))
    want = sorted(map(tuple, jobs.batch_profiles(spark.createDataFrame(rows, jobs.SAMPLES)).collect()))
    assert got == want and len(got) == 14 and [r[-1] for r in got if r[0] == "silent"] == [False]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"j{k}", k)], "job string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("job string, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.write_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    read = lambda: sorted(map(tuple, jobs.read_batches(spark, f"{tmp_path}/out", "job string, n int").collect()))
    before = read()
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # the writer was lost before it noted its last batch
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    jobs.write_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert read() == before == [("j0", 0), ("j1", 1), ("j2", 2)]


def test_progress_counts_jobs(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(f"j{k}{i}", i) for i in range(k + 1)], "job string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []
    with watched(spark, Progress(10, lambda done, total: told.append((done, total)))) as progress:
        stream = spark.readStream.schema("job string, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.write_batches(counted(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        until = time.time() + 20
        while progress.done < 10 and time.time() < until:
            time.sleep(0.1)
    assert told[-1] == (10, 10) and len(told) == 4 and [d for d, _ in told] == sorted(d for d, _ in told) and progress.failed is None


def test_cancelled_work_leaves_nothing(spark, tmp_path):
    slow = spark.range(0, 10**12, 1, 4).select(F.sum(F.hash("id")).alias("s"))
    out, failed = str(tmp_path / "out"), []

    def work(stopper):
        try:
            with cancellable(spark, "slow") as stop:
                stopper.append(stop)
                slow.write.parquet(out)
        except Exception as error:  # noqa: BLE001  whatever the cancelled write gives
            failed.append(error)

    stopper = []
    thread = threading.Thread(target=work, args=(stopper,))
    thread.start()
    until = time.time() + 60
    while time.time() < until and not (stopper and spark.sparkContext.statusTracker().getActiveJobsIds()):
        time.sleep(0.1)
    stopper[0]()
    thread.join(60)
    assert not thread.is_alive() and failed
    assert not [p for p in (tmp_path / "out").rglob("part-*")] and not (tmp_path / "out" / "_SUCCESS").exists()
    assert spark.range(5).count() == 5  # other work goes on


def test_stop_all(spark, tmp_path):
    query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
    stop_all(spark)
    assert not query.isActive and not spark.streams.active
