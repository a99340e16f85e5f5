"""Memory samples as a stream: the same aggregations as over stored samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "job string, ts timestamp, pid int, rss bigint"


def read_samples(spark: SparkSession, path: str, schema: str = SAMPLES, max_files: int = 100) -> DataFrame:
    """A stream of the parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ticks(samples: DataFrame, tick: str = "50 milliseconds", late: str = "1 second") -> DataFrame:
    """(job, tick, rss): sums a job and tumbling window; samples later than `late` are dropped by the watermark of a stream."""
    source = samples.withWatermark("ts", late) if samples.isStreaming else samples
    return source.groupBy("job", F.window("ts", tick).alias("w")).agg(F.sum("rss").alias("rss")).select("job", F.col("w.start").alias("tick"), "rss")


def write_ticks(stream: DataFrame, out: str, checkpoint: str):
    """Finished ticks to parquet, each once; a restarted query goes on from the checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def peaks(tick_rows: DataFrame) -> DataFrame:
    """(job, max_rss, n_ticks) of stored ticks."""
    return tick_rows.groupBy("job").agg(F.max("rss").alias("max_rss"), F.count("*").alias("n_ticks"))
