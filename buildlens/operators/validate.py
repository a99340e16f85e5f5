"""Strict reading of compiler traces: spans, statistics and metadata, or a typed error.

Every event gets the first error that a reader in file order would meet; the first
event with one decides for its trace.  Errors are rows, so one bad trace of many does
no harm; strict mode raises on any.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from buildlens.catalogue import activity_types, dim_activity
from buildlens.functions.arguments import infer_type
from buildlens.operators import documents as whole
from buildlens.operators import forest
from buildlens.operators.brackets import nest_in_chunks
from buildlens.operators.shared import bound_batches
from buildlens.sources.ranges import event_texts
from buildlens.sources.traces import absent, all_events, documents, is_number, is_string, kind, malformed, raw_events


@dataclass
class Loaded:
    """traces, forest, global_stats and rejects of the traces that were read.

    They share the checked events and the nested spans, which stay on the executors'
    memory and disks, to be computed anew if lost, until release().
    """

    traces: DataFrame
    forest: DataFrame
    global_stats: DataFrame
    rejects: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


class TraceError(ValueError):
    """Raised in strict mode."""


def document_error(docs: DataFrame) -> Column:
    """Error of the document as a whole, null if none."""
    fields = ["systemTraceEvents", "powerTraceAsString", "stackFrames", "samples", "controllerTraceDataKey"]
    no_value = lambda c: F.coalesce(F.schema_of_variant(F.col(c)), F.lit("VOID")) == "VOID"
    extra = ~no_value("displayTimeUnit") & F.coalesce(F.expr("try_variant_get(displayTimeUnit, '$', 'string')") != "ms", F.lit(True))
    for c in fields:
        extra = extra | ~no_value(c)
    begun = F.schema_of_variant(F.col("beginningOfTime"))
    return (
        F.when(F.col("events").isNull(), "CtfParseError")
        .when(extra, "UnexpectedTraceMetadata")
        .when(begun.isNotNull() & ~begun.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "InvalidBeginningOfTime")
    )


def route(events: DataFrame) -> Column:
    """span, stat, process_name, thread_name, or the error for what a compiler does not write."""
    return (
        F.when((F.col("ph") == "X") & (F.col("ts") > 1.0), "span")
        .when(F.col("ph") == "X", "stat")
        .when((F.col("ph") == "M") & F.col("name").isin("process_name", "thread_name"), F.col("name"))
        .when(F.col("ph") == "M", "UnexpectedMetadataEvent")
        .otherwise("UnexpectedEvent")
    )


def argument_error(arg_type: Column) -> Column:
    """Error of a span's args under its type (null: unknown activity), null if none."""
    keys = F.coalesce(F.map_keys("arg_kinds"), F.array())
    only_detail = F.size(F.filter(keys, lambda k: k != "detail")) == 0
    has = F.array_contains(keys, "detail")
    nothing = F.when(F.size(keys) > 0, "UnexpectedKeys")
    detail = F.when(~only_detail, "UnexpectedKeys").when(~has, "MissingKey").when(~is_string("detail", "arg_kinds"), "UnexpectedValue")
    optional = F.when(only_detail & ~has, None).otherwise(detail)
    inferred = F.when(F.size(keys) == 0, None).otherwise(detail)
    return F.when(arg_type.isNull(), inferred).when(arg_type == "Nothing", nothing).when(arg_type.isin("SymbolOpt", "UnnamedLoopOpt"), optional).otherwise(detail)


def own_errors(events: DataFrame, *more: str) -> DataFrame:
    """trace_id, raw_pos, `more`, route, name, pid, ts, dur, catalogue_type, malformed, detail, named, count, own (error that an event has by itself), own_detail.

    Filters with functions keep all checks out of whole-stage code, which would put them into one method too large to be compiled.
    """
    dim = F.broadcast(dim_activity(events.sparkSession))  # some 120 rows
    events = events.withColumn("route", route(events)).join(dim, (F.col("route") == "span") & (F.col("name") == F.col("activity")), "left").drop("activity")
    own = lambda: ((F.col("pid") == 1) & (F.col("tid") == 0)) | (F.col("tid") == F.col("pid"))
    bare = reduce(and_, (absent(c) for c in ("cat", "tts", "tdur", "sf", "stack", "esf", "estack")))
    named = is_string("name")
    meta_ok = is_string("cat") & absent("tts") & (F.size("cat") == 0) & (F.coalesce("ts", F.lit(-1.0)) == 0.0) & (F.size("arg_kinds") == 1)
    keys = F.map_keys("arg_kinds")
    stat_args = (
        F.when(F.size(F.filter(keys, lambda k: ~k.isin("count", "avg ms"))) > 0, "UnexpectedKeys")
        .when(F.array_contains(keys, "count") & ~F.coalesce((kind("count", "arg_kinds") == "BIGINT") & (F.col("count") >= 0), F.lit(False)), "UnexpectedValue")
        .when(F.array_contains(keys, "avg ms") & ~is_number("avg ms", "arg_kinds"), "UnexpectedValue")
        .when(F.size(keys) < 2, "MissingKey")
    )
    stat = F.when(~(named & bare & (F.col("tid") != 0) & (F.col("ts") == 0.0) & ~absent("args")), "UnexpectedInput").when(~F.col("name").startswith("Total "), "NoTotalPrefix").when(stat_args.isNotNull(), stat_args)
    span = F.when(~(named & bare & own()), "UnexpectedInput").otherwise(argument_error(F.col("catalogue_type")))
    events = events.select(
        "trace_id", "raw_pos", *more, "route", "name", "pid", "ts", "dur", "catalogue_type", malformed().alias("malformed"), "detail", "named", "count",
        F.when(F.col("route") == "span", span).when(F.col("route") == "stat", stat).alias("own_detail"),
        F.when(F.col("route") == "process_name", F.coalesce(meta_ok & own(), F.lit(False))).when(F.col("route") == "thread_name", F.coalesce(meta_ok & (F.col("pid") == F.col("tid")), F.lit(False))).alias("__named"),
    )
    error = (
        F.when(F.col("route").isin("UnexpectedEvent", "UnexpectedMetadataEvent"), F.col("route"))
        .when(~F.col("__named"), "NameParseError")
        .when(F.col("own_detail").isNotNull(), F.when(F.col("route") == "span", "ActivityStatParseError").otherwise("GlobalStatParseError"))
    )
    return events.withColumn("own", error).drop("__named")


def event_errors(events: DataFrame) -> DataFrame:
    """`own_errors` with error (null if none), which may hang on the events before, and detail of the error."""
    events = own_errors(events)
    by_pos = Window.partitionBy("trace_id").orderBy("raw_pos")
    earlier = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    first_pid = F.first(F.when(F.col("route") != "UnexpectedEvent", F.col("pid")), ignorenulls=True).over(by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    events = events.withColumn("__first_pid", first_pid)
    for what, name in (("process_name", "__processes"), ("thread_name", "__threads")):
        events = events.withColumn(name, F.coalesce(F.sum((F.col("route") == what).cast("int")).over(earlier), F.lit(0)))
    again = Window.partitionBy("trace_id", "route", "name").orderBy("raw_pos")
    events = events.withColumn("__nth", F.row_number().over(again))
    ends = Window.partitionBy("trace_id", "route").orderBy("raw_pos")
    events = events.withColumn("__before", F.lag(F.col("ts") + F.col("dur")).over(ends))
    error = (
        F.when(F.col("route").isin("UnexpectedEvent", "UnexpectedMetadataEvent"), F.col("route"))
        .when(F.col("pid") != F.col("__first_pid"), "InconsistentPid")
        .when(F.col("own").isNotNull(), F.col("own"))
        .when((F.col("route") == "span") & (F.col("ts") + F.col("dur") < F.col("__before")), "ActivityTreeError")
        .when((F.col("route") == "stat") & (F.col("__nth") > 1), "DuplicateGlobalStat")
        .when((F.col("route") == "process_name") & (F.col("__processes") > 0), "DuplicateProcessName")
        .when((F.col("route") == "thread_name") & (F.col("__threads") > 0), "DuplicateThreadName")
    )
    what = F.coalesce("own_detail", F.when(error == "ActivityTreeError", "UnexpectedActivityOrder"))
    return events.withColumn("error", error).withColumn("error_detail", F.when(error.isNotNull(), what)).drop("__first_pid", "__processes", "__threads", "__nth", "__before")


def typed(spans: DataFrame) -> DataFrame:
    """`spans` with known, and arg_type in place of catalogue_type."""
    return spans.withColumn("known", F.col("catalogue_type").isNotNull()).withColumn("arg_type", F.coalesce("catalogue_type", infer_type(F.col("detail")), F.lit("Nothing"))).drop("catalogue_type")


_PACKED = "kind int, data binary"
#: Besides trace_id, what is read of a document (kind 0), its spans (1), its statistics (2), and one that is left (-1).
_READ = (
    "raw_pos int, error string, detail string, process_name string, pid int, thread_name string, beginning_of_time double",
    "pos int, activity string, detail string, catalogue_type string, start double, duration double, first_pos int, depth int, parent_pos int, parent_duration double, n_children int, self_duration double",
    "activity string, duration double, count bigint",
    "text binary",
)


def load(texts: DataFrame, strict: bool = False, arrays: bool = False) -> Loaded:
    """Traces from (trace_id, text); see _load.

    A document is a cell, so its events are checked and nested where it is parsed: nothing is shuffled.
    Plain documents without errors are read at once; the others are left to the checks that tell what is wrong.
    """
    bound_batches(texts.sparkSession)
    key = texts.schema["trace_id"].dataType
    told, spans, stats, left = (StructType([StructField("trace_id", key), *StructType.fromDDL(more).fields]) for more in _READ)
    every = to_arrow_schema(StructType(list({f.name: f for kind in (told, spans, stats, left) for f in kind}.values())))
    plain = texts.select("trace_id", "text").mapInArrow(whole.plain_documents(every, activity_types(), arrays, whole.PLAIN_BYTES), _PACKED).persist()

    def rows(kind: int, schema: StructType, *frames: DataFrame) -> DataFrame:
        parts = [f.where(F.col("kind") == kind).select("data").mapInArrow(whole.unpacked(to_arrow_schema(schema)), schema) for f in frames]
        return reduce(DataFrame.unionByName, parts)

    docs = documents(rows(-1, left, plain).withColumn("text", F.col("text").cast("string")), arrays)
    events = own_errors(raw_events(all_events(docs.withColumn("error", document_error(docs))), "doc_error", "epoch"), "doc_error", "epoch")
    other = events.mapInArrow(whole.whole_documents(every), _PACKED).persist()
    rejects = rows(0, told, other).where("error is not null").select("trace_id", "raw_pos", "error", "detail")
    if strict:
        raise_any(rejects)
    traces = rows(0, told, plain, other).where("error is null").select("trace_id", "process_name", F.when(F.col("pid") > 1, F.col("pid")).alias("pid"), "thread_name", "beginning_of_time")
    forest_ = typed(rows(1, spans, plain, other)).select(
        "trace_id", "pos", "activity", "known", "detail", "start", "duration", "arg_type", (F.col("start") + F.col("duration")).alias("end"), "first_pos", "depth", "parent_pos", "parent_duration", "n_children", "self_duration",
        (F.col("pos") - F.col("first_pos")).alias("n_descendants"),
    )
    totals = rows(2, stats, plain, other).select("trace_id", F.expr("substring(activity, 7)").alias("name"), F.col("duration").alias("total_duration"), "count")
    return Loaded(traces, forest_, totals.withColumn("average_duration", F.try_divide("total_duration", F.col("count"))), rejects, (plain, other))


def raise_any(rejects: DataFrame) -> None:
    if bad := rejects.orderBy("trace_id").first():
        raise TraceError(f"{bad['trace_id']}: {bad['error']}" + (f" ({bad['detail']})" if bad["detail"] else ""))


def load_ranges(spark: SparkSession, *paths: str, strict: bool = False, arrays: bool = False) -> Loaded:
    """As `load` of the files' texts, but read by byte ranges: files may be larger than a cell or a task."""
    events, rests = event_texts(spark, *paths, arrays=arrays)
    docs = documents(rests, arrays)
    docs = docs.withColumn("error", document_error(docs)).persist()
    good = docs.where("error is null").select("trace_id")
    parsed = events.select("trace_id", F.col("raw_pos").cast("int").alias("raw_pos"), F.try_parse_json("text").alias("e"))
    return _load(docs, parsed.join(good, "trace_id", "left_semi"), strict)


def _load(docs: DataFrame, listed: DataFrame, strict: bool) -> Loaded:
    """Traces from documents and their events.

    rejects has one row a bad trace: trace_id, raw_pos (null for the document as a
    whole), error, detail.  A trace without events has NoProcessName.  Bad traces have
    no rows elsewhere.
    """
    checked = event_errors(raw_events(listed)).drop("own", "own_detail").persist()
    malformed = checked.groupBy("trace_id").agg(F.max("malformed").alias("bad")).where("bad").select("trace_id", F.lit(None).cast("int").alias("raw_pos"), F.lit("CtfParseError").alias("error"), F.lit(None).cast("string").alias("detail"))
    per_trace = docs.where("error is null").select("trace_id", F.expr("try_variant_get(beginningOfTime, '$', 'double')").alias("beginning_of_time"))
    found = checked.groupBy("trace_id").agg(
        F.min(F.when(F.col("error").isNotNull(), F.struct("raw_pos", "error", "error_detail"))).alias("first"),
        F.min(F.when(F.col("route") == "process_name", F.struct("raw_pos", F.col("named").alias("v")))).alias("process"),
        F.min(F.when(F.col("route") == "thread_name", F.struct("raw_pos", F.col("named").alias("v")))).alias("thread"),
        F.min_by("pid", F.when(F.col("pid").isNotNull(), F.col("raw_pos"))).alias("pid"),
    )
    traces = per_trace.join(found, "trace_id", "left")
    spans = checked.where("route = 'span' and error is null").select(
        "trace_id", (F.row_number().over(Window.partitionBy("trace_id").orderBy("raw_pos")) - 1).alias("pos"), F.col("name").alias("activity"), "detail", "catalogue_type", F.col("ts").alias("start"), F.col("dur").alias("duration"),
    )
    nested = nest_in_chunks(typed(spans), sums=True).persist()
    overlapping = forest.overlapping_traces(nested).withColumn("overlap", F.lit(True))
    status = traces.join(malformed.select("trace_id", F.lit(True).alias("malformed")), "trace_id", "left").join(overlapping, "trace_id", "left")
    error = F.when(F.col("malformed"), "CtfParseError").when(F.col("first").isNotNull(), F.col("first.error")).when(F.col("overlap"), "ActivityTreeError").when(F.col("process").isNull(), "NoProcessName")
    detail = F.when(F.col("malformed"), None).when(F.col("first").isNotNull(), F.col("first.error_detail")).when(F.col("overlap"), "PartialActivityOverlap")
    status = status.withColumn("error", error).withColumn("detail", detail)
    rejects = docs.where("error is not null").select("trace_id", F.lit(None).cast("int").alias("raw_pos"), "error", F.lit(None).cast("string").alias("detail"))
    rejects = rejects.union(status.where("error is not null").select("trace_id", F.when(~F.coalesce("malformed", F.lit(False)), F.col("first.raw_pos")), "error", "detail"))
    if strict:
        raise_any(rejects)
    good = status.where("error is null").select("trace_id", F.col("process.v").alias("process_name"), F.when(F.col("pid") > 1, F.col("pid")).alias("pid"), F.col("thread.v").alias("thread_name"), "beginning_of_time")
    ids = good.select("trace_id")
    stats = checked.where("route = 'stat' and error is null").select("trace_id", F.expr("substring(name, 7)").alias("name"), F.col("dur").alias("total_duration"), "count")
    stats = stats.join(ids, "trace_id", "left_semi")
    return Loaded(good, nested.join(ids, "trace_id", "left_semi"), stats.withColumn("average_duration", F.try_divide("total_duration", F.col("count"))), rejects, (docs, checked, nested))
