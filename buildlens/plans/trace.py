"""A loaded trace, or many: what one asks of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.arguments import detail_kind, symbol_state
from buildlens.functions.names import bounded_entity, entity_renderings
from buildlens.functions.paths import shorten_path
from buildlens.functions.text import columns_of, shorten
from buildlens.operators import forest as trees
from buildlens.operators import profile as profiles
from buildlens.operators.validate import Loaded, load, load_ranges
from buildlens.sources.traces import read_trace_texts


class Traces:
    """Questions to the forest of one or more traces; every answer is a DataFrame."""

    def __init__(self, loaded: Loaded):
        self.loaded = loaded
        self.spans = loaded.forest

    @staticmethod
    def read(spark: SparkSession, *paths: str, strict: bool = True) -> Traces:
        return Traces(load(read_trace_texts(spark, *paths), strict))

    @staticmethod
    def read_ranges(spark: SparkSession, *paths: str, strict: bool = True) -> Traces:
        """As `read`, for files of any size: no trace is held in one cell while it is read."""
        return Traces(load_ranges(spark, *paths, strict=strict))

    def roots(self) -> DataFrame:
        return trees.roots(self.spans)

    def children(self, pos: int) -> DataFrame:
        return trees.zoom(self.spans, pos)

    def descendants(self, pos: int) -> DataFrame:
        return trees.zoom(self.spans, pos, flat=True)

    def ancestors(self, pos: int) -> DataFrame:
        """Innermost first."""
        return trees.ancestors(self.spans, trees.span_at(self.spans, pos)).orderBy("trace_id", "pos")

    def breakdown(self, by: list[str] | None = None) -> DataFrame:
        return profiles.activity_breakdown(self.spans, by)

    def profile(self, **options) -> DataFrame:
        return profiles.profile(self.spans, **options)

    def described(self, spans: DataFrame, cols: int) -> DataFrame:
        return described(spans, cols)


def described(spans: DataFrame, cols: int) -> DataFrame:
    """`spans` with description: `Activity(detail)` in at most `cols` columns, null where not even `Activity(…)` fits.

    To be called on the rows that are shown, after thresholds: details are shortened by what they
    are, names by the depth of their lists, each distinct text once a batch.  What is left for the
    detail is a column.  A symbol that may be mangled is shown as it is, its middle elided.
    """
    name, detail = F.col("activity"), F.col("detail")
    room = F.lit(cols) - columns_of(name) - 2
    space = F.greatest(room, F.lit(1))
    kind = detail_kind(F.col("arg_type"), detail)
    entity = (kind == "CppEntity") | ((kind == "Symbol") & (symbol_state(detail) == "Parsed"))
    path = kind.isin("FilePath", "FilePathOrModule") & detail.startswith("/")
    text = F.when(entity, bounded_entity(entity_renderings(F.when(entity, detail)), space)).when(path, F.coalesce(shorten_path(F.when(path, detail), space), shorten(detail, space))).otherwise(shorten(detail, space))
    bare = F.when(columns_of(name) <= cols, name)
    return spans.withColumn("description", F.when(detail.isNull(), bare).when(room >= 1, F.concat(name, F.lit("("), text, F.lit(")"))))
