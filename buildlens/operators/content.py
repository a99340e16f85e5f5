"""What the details of traces hold: exact counts a trace, and sketches that merge over builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log2 of the registers of a sketch; its relative standard error is about 1.04 / sqrt(2 ** SKETCH).
SKETCH = 12
KINDS = ("activities", "details", "paths", "path_parts", "entities", "identifiers", "scopes", "arguments")


def kinds_of(activity: Column, detail: Column) -> dict[str, Column]:
    """Of one span, the items of each kind as an array of texts: null where the kind doesn't occur.

    Paths are details that begin with /, entities all other details but [module].  Identifiers are
    words of an entity, scopes its words in front of ::, arguments what stands between brackets and
    commas of its innermost lists.
    """
    path = F.when(detail.startswith("/"), detail)
    entity = F.when(~detail.startswith("/") & (detail != "[module]"), detail)
    pick = lambda pattern, group=0: F.regexp_extract_all(entity, F.lit(pattern), F.lit(group))
    return {
        "activities": F.array(activity), "details": F.when(detail.isNotNull(), F.array(detail)), "paths": F.when(path.isNotNull(), F.array(path)), "path_parts": F.filter(F.split(path, "/"), lambda x: x != ""),
        "entities": F.when(entity.isNotNull(), F.array(entity)), "identifiers": pick(r"[A-Za-z_][A-Za-z0-9_]*"), "scopes": pick(r"([A-Za-z_][A-Za-z0-9_]*)::", 1),
        "arguments": F.flatten(F.transform(pick(r"<([^<>]+)>", 1), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y)))),
    }


def _items(spans: DataFrame, by: list[str]) -> DataFrame:
    """by, kind, items (an array) of every span and kind that it has."""
    kinds = kinds_of(F.col("activity"), F.col("detail"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("items")) for k, v in kinds.items()])
    return spans.select(*by, F.explode(pairs).alias("p")).select(*by, "p.kind", F.col("p.items").alias("items")).where("size(items) > 0")


def trace_statistics(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by (trace_id by default), kind, n_items, n_distinct, longest: how much of each of KINDS the spans hold.

    Equal items of a task are counted once before they are shuffled.
    """
    by = ["trace_id"] if by is None else by
    items = _items(spans, by)
    each = items.select(*by, "kind", F.size("items").alias("length"), F.explode("items").alias("item"))
    distinct = each.groupBy(*by, "kind", "item").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    return distinct.groupBy(*by, "kind").agg(F.sum("n").alias("n_items"), F.count("*").alias("n_distinct"), F.max("longest").alias("longest"))


def sketches(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, kind, n_items, sketch: what is kept of a build, however many distinct items it has."""
    by = ["trace_id"] if by is None else by
    each = _items(spans, by).select(*by, "kind", F.explode("items").alias("item"))
    return each.groupBy(*by, "kind").agg(F.count("*").alias("n_items"), F.hll_sketch_agg("item", F.lit(SKETCH)).alias("sketch"))


def merged(kept: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`sketches` of many traces or builds as one a key of `by`: n_items and about how many distinct ones."""
    keys = [*(by or []), "kind"]
    union = kept.groupBy(*keys).agg(F.sum("n_items").alias("n_items"), F.hll_union_agg("sketch").alias("sketch"))
    return union.withColumn("about_distinct", F.hll_sketch_estimate("sketch"))
