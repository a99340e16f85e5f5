"""Dictionaries of values, sequences and paths: keys that are equal exactly if the values are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.paths import components
from buildlens.operators.shared import numbered


def key_of(value: Column) -> Column:
    """A 64-bit key from the value alone: the same in every job, without a table."""
    return F.xxhash64(value)


def dictionary(rows: DataFrame, value: str, key: str = "key") -> DataFrame:
    """(key, value): the distinct values with their keys; distinct() meets map-side first."""
    return rows.select(value).where(F.col(value).isNotNull()).distinct().withColumn(key, key_of(F.col(value))).select(key, value)


def collisions(table: DataFrame, key: str = "key") -> DataFrame:
    """Keys that more than one value has: none, or the dictionary can't be used."""
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dense_keys(rows: DataFrame, value: str) -> DataFrame:
    """(key, value) with keys 0, 1, ... in the order of values, without a window over all of them.

    Values are range-partitioned and sorted; a partition's keys begin where those of
    the partitions before it end.  Only a count a partition reaches the driver.
    """
    values = rows.select(value).where(F.col(value).isNotNull()).distinct()
    return numbered(values, "key", value).select("key", value)


def encode(rows: DataFrame, value: str, key: str) -> DataFrame:
    """`rows` with the value's key in its place."""
    return rows.withColumn(key, F.when(F.col(value).isNotNull(), key_of(F.col(value)))).drop(value)


def decode(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(table, key, "left")


def sequence_dictionary(rows: DataFrame, items: str) -> DataFrame:
    """(key, items): distinct arrays."""
    return dictionary(rows, items)


def path_dictionary(rows: DataFrame, path: str) -> DataFrame:
    """(path_id, components) of the distinct absolute paths in normal form."""
    parts = rows.select(components(F.col(path)).alias("components"))
    return dictionary(parts, "components", "path_id")


def statistics(rows: DataFrame, items: str) -> DataFrame:
    """One row on a column of arrays: n_sequences, n_distinct, n_items, n_distinct_items, max_length."""
    distinct = rows.select(items).where(F.col(items).isNotNull()).groupBy(items).agg(F.count("*").alias("n"))
    whole = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_sequences"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.size(items).cast("bigint")), F.lit(0).cast("bigint")).alias("n_items"), F.max(F.size(items)).alias("max_length"))
    one = distinct.select(F.explode(items).alias("x")).distinct().agg(F.count("*").alias("n_distinct_items"))
    return whole.crossJoin(F.broadcast(one))  # a row each
