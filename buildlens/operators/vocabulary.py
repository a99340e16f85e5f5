"""Dictionaries that live: written tables whose keys never change, and which grow by what is new."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.operators.shared import numbered


@dataclass(frozen=True)
class Vocabulary:
    """A table of (key, value, version) in buckets of value, which one writer at a time appends to.

    Keys are 0, 1, ... without gaps.  A version is what one `grow` added; `at(version)` is the
    vocabulary as it was then, which is how readers keep a frozen one while it grows.  An append
    is whole or absent: readers see a table's files as of its last commit, and the keys of a failed
    append are given again.
    """

    spark: SparkSession
    table: str
    version: int | None = None
    buckets: int = 32
    path: str | None = None  # where the table's files lie; by default in the warehouse

    def rows(self) -> DataFrame:
        """(key, value, version)."""
        if not self.spark.catalog.tableExists(self.table):
            return self.spark.createDataFrame([], "key bigint, value string, version int")
        out = self.spark.table(self.table)
        return out if self.version is None else out.where(F.col("version") <= self.version)

    def at(self, version: int) -> Vocabulary:
        return replace(self, version=version)

    def latest(self) -> int:
        """Number of the last version; 0 for none."""
        return self.rows().agg(F.max("version")).first()[0] or 0

    def frozen(self) -> Vocabulary:
        """This vocabulary as it is now, whatever is added later: it can be read only."""
        return self.at(self.latest())

    def grow(self, rows: DataFrame, value: str) -> Vocabulary:
        """Add the values that have no key yet, in their order; null is no value.  Gives the vocabulary as of then.

        New values are found by an anti-join with the buckets, numbered by partition offsets and
        appended; nothing that has a key is written again.
        """
        if self.version is not None:
            raise ValueError(f"version {self.version} of {self.table} is frozen")
        known = self.rows()
        size, last = known.agg(F.coalesce(F.max("key") + 1, F.lit(0)), F.coalesce(F.max("version"), F.lit(0))).first()
        asked = rows.select(F.col(value).cast("string").alias("value")).where("value is not null").distinct()
        new = numbered(asked.join(known.select("value"), "value", "left_anti"), "key", "value")
        new = new.select((F.col("key") + size).alias("key"), "value", F.lit(last + 1).alias("version"))
        if new.isEmpty():
            return self.at(last)
        writer = new.write.bucketBy(self.buckets, "value").sortBy("value").mode("append")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)
        return self.at(last + 1)

    def encode(self, rows: DataFrame, value: str, key: str) -> DataFrame:
        """`rows` with the value's key in its place, null for values without one.  The table's side is not shuffled; nor are rows in the same buckets."""
        table = self.rows().select(F.col("value").alias("__value"), F.col("key").alias(key))
        return rows.join(table, F.col(value) == F.col("__value"), "left").drop("__value", value)

    def decode(self, rows: DataFrame, key: str, value: str) -> DataFrame:
        table = self.rows().select(F.col("key").alias("__key"), F.col("value").alias(value))
        return rows.join(table, F.col(key) == F.col("__key"), "left").drop("__key", key)
