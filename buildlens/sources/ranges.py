"""Time traces of any size, read by byte ranges.

Spark's text reader cuts a file into ranges and reads each up to its next separator; with } as the
separator its rows are pieces that end where an object may end, and no file is held in one cell.
Whether the } of a piece is part of a text, and how deep it stands, hangs on all pieces before it.
So both are worked out twice, as if the range began inside or outside a text: the parity of quotes
and the balance of brackets.  A row a range is left; prefix sums over these rows say which of the
two was right and where the range really begins.  Pieces then meet by the number of their event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.operators.shared import checkpoint

_OPENING = r'"traceEvents"\s*:\s*\['


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _pieces(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """trace_id, block, nth (ascending in a block), value, file_size, and what a piece means if it begins outside (0) or inside (1) a text."""
    raw = spark.read.option("lineSep", "}").text(list(paths))
    raw = raw.select(F.col("_metadata.file_path").alias("trace_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value", F.col("_metadata.file_size").alias("file_size"))
    bare = F.regexp_replace("value", r"\\.", "__")  # no escape goes over a }
    quoted = '"[^"]*(?:"|$)'
    outside = (F.regexp_replace(bare, quoted, ""), F.regexp_replace(F.regexp_replace(bare, '^[^"]*(?:"|$)', ""), quoted, ""))
    raw = raw.withColumn("__bare", bare).withColumn("quotes", _count(F.col("__bare"), '"') % 2)
    for k, text in enumerate(outside):
        raw = raw.withColumn(f"__out{k}", text)
        level = _count(F.col(f"__out{k}"), "{") + _count(F.col(f"__out{k}"), "[") - _count(F.col(f"__out{k}"), "]")
        closes = (F.col("quotes") == k).cast("int")  # outside at its end, so the } counts
        raw = raw.withColumn(f"rise{k}", level).withColumn(f"step{k}", F.col(f"rise{k}") - closes).withColumn(f"leaves{k}", F.regexp_replace(f"__out{k}", r"[^\[\]{]", "").startswith("]"))
    before = F.regexp_replace(F.element_at(F.split("__bare", _OPENING, 2), 1), quoted, "")
    opens_at = F.when(F.col("__bare").rlike(_OPENING), _count(before, "{") + _count(before, "[") - _count(before, "]"))
    return raw.withColumn("opens_at", opens_at).drop("__bare", "__out0", "__out1")


def _placed(pieces: DataFrame) -> DataFrame:
    """`pieces` with depth (where each begins), ends (whether its } closes something), after (the depth then)."""
    block, order = ["trace_id", "block"], Window.partitionBy("trace_id", "block").orderBy("nth")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    done = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = pieces.withColumn("__odd", done("quotes", ahead) % 2)
    for p in (0, 1):  # p: whether the block begins in a text
        turned = F.col("__odd") != p
        rows = rows.withColumn(f"__step{p}", F.when(turned, F.col("step1")).otherwise(F.col("step0")))
        rows = rows.withColumn(f"__depth{p}", done(f"__step{p}", ahead))
    blocks = rows.groupBy(*block).agg((F.sum("quotes") % 2).alias("q"), F.sum("__step0").alias("s0"), F.sum("__step1").alias("s1"))
    by_block = Window.partitionBy("trace_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = blocks.withColumn("inside", done("q", by_block) % 2)
    blocks = blocks.withColumn("base", done(F.when(F.col("inside") == 1, F.col("s1")).otherwise(F.col("s0")), by_block)).select(*block, "inside", "base")
    rows = rows.join(blocks, block)
    turned = F.col("inside") == 1
    rows = rows.withColumn("depth", F.col("base") + F.when(turned, F.col("__depth1")).otherwise(F.col("__depth0")))
    rows = rows.withColumn("__in", (F.col("__odd") + F.col("inside")) % 2)
    pick = lambda name: F.when(F.col("__in") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    rows = rows.withColumn("ends", (F.col("quotes") + F.col("__in")) % 2 == 0).withColumn("after", F.col("depth") + pick("step")).withColumn("leaves", pick("leaves"))
    return rows.select(*block, "nth", "value", "file_size", "depth", "ends", "after", "leaves", "opens_at")


def event_texts(spark: SparkSession, *paths: str, arrays: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, rests): trace_id, raw_pos, text of every event; trace_id, text of each document without its events.

    Events are those of the list traceEvents of a document, or with `arrays` those of a document
    that is one bare list.  What stands between two events beside a comma is part of the later
    one's text, which is then no JSON.  A rest is one cell: what is not an event must be small.
    """
    placed = checkpoint(_placed(checkpoint(_pieces(spark, paths))))
    at = F.struct("block", "nth")
    whole = placed.groupBy("trace_id").agg(
        F.min_by("value", at).alias("__head"), F.max(at).alias("__last"), (F.sum(F.octet_length("value")) + F.count("*") == F.max("file_size")).alias("__closed"),
        F.min(F.when(F.col("opens_at") + F.col("depth") == 1, at)).alias("__listed"), F.min(at).alias("__first"),
    )
    is_list = F.ltrim("__head").startswith("[") if arrays else F.lit(False)
    whole = whole.withColumn("__level", F.when(is_list, 2).otherwise(3)).withColumn("__enter", F.when(is_list, F.col("__first")).otherwise(F.col("__listed"))).drop("__head", "__listed", "__first")
    rows = placed.join(whole, "trace_id").withColumn("__at", at)
    rows = rows.withColumn("ends", F.col("ends") & ((F.col("__at") != F.col("__last")) | F.col("__closed")))
    head = F.when(F.col("__level") == 2, F.lit(r"^\s*\[")).otherwise(F.lit(rf"^(?s).*?{_OPENING}"))
    rows = rows.withColumn("__cut", F.when(F.col("__at") == F.col("__enter"), F.length(F.regexp_substr("value", head))))
    rows = rows.withColumn("__inner", F.when(F.col("__cut").isNotNull(), F.expr("substring(value, __cut + 1)")).otherwise(F.col("value")))
    left = F.when(F.col("__cut").isNotNull(), F.ltrim("__inner").startswith("]")).otherwise((F.col("depth") == F.col("__level") - 1) & F.col("leaves") & (F.col("__at") > F.col("__enter")))
    leave = rows.where(left).groupBy("trace_id").agg(F.min("__at").alias("__leave"))
    rows = rows.join(leave, "trace_id", "left").withColumn("__inside", F.coalesce((F.col("__at") >= F.col("__enter")) & F.coalesce(F.col("__at") < F.col("__leave"), F.lit(True)), F.lit(False)))
    over = F.col("__inside") & F.col("ends") & (F.col("after") == F.col("__level") - 1)
    rows = rows.withColumn("__over", over.cast("int"))
    # events before a piece: those of its block, and of the blocks before it
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c, w: F.coalesce(F.sum(c).over(ahead(w)), F.lit(0))
    blocks = rows.groupBy("trace_id", "block").agg(F.sum("__over").alias("__n"))
    blocks = blocks.withColumn("__before", count("__n", Window.partitionBy("trace_id").orderBy("block"))).drop("__n")
    rows = rows.withColumn("__mine", count("__over", Window.partitionBy("trace_id", "block").orderBy("nth"))).join(blocks, ["trace_id", "block"])
    rows = rows.withColumn("raw_pos", (F.col("__mine") + F.col("__before")).cast("bigint"))
    text = lambda c: F.concat(c, F.when((F.col("__at") != F.col("__last")) | F.col("__closed"), F.lit("}")).otherwise(F.lit("")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "nth", F.col("__text").alias("t")))), lambda x: x.t), "")
    inner = rows.where("__inside").withColumn("__text", text(F.col("__inner")))
    events = inner.groupBy("trace_id", "raw_pos").agg(joined.alias("text"), F.max("__over").alias("__whole")).where("__whole = 1 or trim(text) <> ''")
    events = events.select("trace_id", "raw_pos", F.when(F.col("raw_pos") > 0, F.regexp_replace("text", r"^\s*,\s*", "")).otherwise(F.col("text")).alias("text"))
    outer = rows.where("not __inside").withColumn("__text", text(F.col("value")))
    heads = rows.where("__inside and __cut is not null").withColumn("__text", F.expr("substring(value, 1, __cut)"))
    rests = outer.unionByName(heads).groupBy("trace_id").agg(joined.alias("text"))
    return events, rests
