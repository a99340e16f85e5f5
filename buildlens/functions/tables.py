"""Table functions: what one text holds, as rows, for LATERAL joins in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from buildlens.functions.arguments import split_words
from buildlens.functions.names import pieces, renderings


def _of_text(text: AnalyzeArgument, schema: StructType) -> AnalyzeResult:
    if not isinstance(text.dataType, StringType):
        raise ValueError(f"a text is needed, not {text.dataType.simpleString()}")
    return AnalyzeResult(schema)


class CommandWords:
    """(pos, word) of a command as a shell splits it; null or unbalanced commands have no words."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _of_text(text, StructType().add("pos", IntegerType()).add("word", StringType()))

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for k, word in enumerate((split_words(text) if text is not None else None) or []):
            yield k, word


class EntityLevels:
    """(depth, rendering, width) of a name with its lists opened ever deeper; the last is the name itself."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _of_text(text, StructType().add("depth", IntegerType()).add("rendering", StringType()).add("width", IntegerType()))

    def eval(self, text: str) -> Iterator[tuple[int, str, int]]:
        from buildlens.functions.text import width

        for k, shown in enumerate(renderings(text) if text is not None else []):
            yield k, shown, width(shown)


class EntityParts:
    """(pos, depth, part): the pieces of a name, and how many lists stand round each."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _of_text(text, StructType().add("pos", IntegerType()).add("depth", IntegerType()).add("part", StringType()))

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        for k, (part, depth) in enumerate(pieces(text) if text is not None else []):
            yield k, depth, part


def register_tables(spark: SparkSession) -> None:
    """command_words(command), entity_levels(name) and entity_parts(name)."""
    for name, kind in (("command_words", CommandWords), ("entity_levels", EntityLevels), ("entity_parts", EntityParts)):
        spark.udtf.register(name, udtf(kind))
