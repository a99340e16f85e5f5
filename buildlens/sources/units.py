"""Compilation databases and unit profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMANDS = "directory string, command string, file string, output string"


class SourceError(ValueError):
    """FileNotFound or ParseError, and what it was about."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """(pos, directory, command, file, output) of a compile_commands.json; a key that no entry may have is an error."""
    if not _exists(spark, path):
        raise SourceError(f"FileNotFound: {path}")
    return commands_from_text(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def commands_from_text(texts: DataFrame) -> DataFrame:
    """As read_commands, from texts.  Rows with an error have it in `error`, and nothing else."""
    raw = texts.select(F.posexplode(F.coalesce(F.from_json("text", "array<variant>"), F.array(F.lit(None).cast("variant")))).alias("pos", "e"))
    keys = F.expr("map_keys(try_variant_get(e, '$', 'map<string,variant>'))")
    fields = {k: F.expr(f"try_variant_get(e, '$.{k}', 'string')") for k in ("directory", "command", "file", "output")}
    stray = F.size(F.filter(keys, lambda k: ~k.isin(*fields))) > 0
    lacks = fields["directory"].isNull() | fields["command"].isNull() | fields["file"].isNull()
    error = F.when(F.coalesce(stray | lacks, F.lit(True)), "ParseError")
    return raw.select("pos", *[F.when(error.isNull(), v).alias(k) for k, v in fields.items()], error.alias("error"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by `order`.  An aggregate, so rows meet map-side first."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last")).select(key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and n of those that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def compilation_database(entries: DataFrame) -> DataFrame:
    """Entries by input file, of repeated ones the last."""
    return last_wins(entries, "file", "pos")


def push(database: DataFrame, entries: DataFrame) -> DataFrame:
    """`database` with more entries; raises if one is there already."""
    out = database.unionByName(entries.select(*database.columns))
    if again := duplicates(out, "file").first():
        raise SourceError(f"already in the database: {again['file']}")
    return out


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(file, max_rss, time) of a CSV with a header file,max_rss[,time]; a row that is none is an error.

    time is float and null where there is no such column; NaN, infinite and negative
    values stay as they are (see wall_time).
    """
    if not _exists(spark, path):
        raise SourceError(f"FileNotFound: {path}")
    header = spark.read.text(path).first()
    names = [c.strip() for c in header[0].split(",")] if header else []
    if names not in (["file", "max_rss"], ["file", "max_rss", "time"]):
        raise SourceError(f"ParseError: header {names}")
    schema = "file string, max_rss string" + ", time string" * (len(names) == 3)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    rss = F.expr("cast(max_rss as decimal(20,0))")
    time = F.expr("cast(nullif(time, '') as float)") if "time" in names else F.lit(None).cast("float")
    return rows.select("file", rss.alias("max_rss"), time.alias("time"))


def write_profile(profiles: DataFrame, path: str) -> None:
    """Unit profiles as CSV, a part file a task.

    The new profile is written beside the old one.  Only when it is whole is the old one
    moved out of the way, and back again if the new one can't take its place; a write
    that fails leaves the old profile as it was.
    """
    spark = profiles.sparkSession
    jvm = spark.sparkContext._jvm
    target, new, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)  # a writer was lost between its two moves
    try:
        profiles.write.mode("overwrite").option("header", True).csv(new.toString())
        fs.delete(old, True)
        backup = fs.exists(target)
        if backup and not fs.rename(target, old):
            raise SourceError(f"cannot move {path}")
        if not fs.rename(new, target):
            if backup:
                fs.rename(old, target)
            raise SourceError(f"cannot write {path}")
        fs.delete(old, True)
    finally:
        fs.delete(new, True)


def listed_files(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """(path, modified, size) of the files at or below `paths`, by a listing: no file is opened.

    A path that does not exist has no row.
    """
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, modified timestamp, size bigint")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(there).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
