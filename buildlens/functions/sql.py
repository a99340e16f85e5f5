"""The text functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from buildlens.functions import arguments, names, paths
from buildlens.functions.tables import register_tables


def register_functions(spark: SparkSession) -> None:
    """entity_renderings(name), shell_words(command) and shorten_path(components, columns), as vectorised functions, and the table functions."""
    spark.udf.register("entity_renderings", names._renderings)
    spark.udf.register("shell_words", arguments._words)
    spark.udf.register("shorten_path", paths._short)
    register_tables(spark)
