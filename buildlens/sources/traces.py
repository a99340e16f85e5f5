"""Time traces: Chrome trace JSON files to events.

A file is a trace.  Its text is parsed once, into an array of one VARIANT an event, and
exploded: the file text itself travels no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DOCUMENT = "traceEvents array<variant>, beginningOfTime variant, displayTimeUnit variant, systemTraceEvents variant, powerTraceAsString variant, stackFrames variant, samples variant, controllerTraceDataKey variant"
_EVENT = "array<variant>"


def read_trace_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(trace_id, text): a row a file, named by its path."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("trace_id"), F.col("value").alias("text"))


def kind(field: str, of: str = "kinds") -> Column:
    """JSON type of a field of an event (or, with "arg_kinds", of its args): BIGINT, DECIMAL(..), DOUBLE, STRING, VOID, ...; null if absent."""
    return F.try_element_at(F.col(of), F.lit(field))


def absent(field: str, of: str = "kinds") -> Column:
    return F.coalesce(kind(field, of), F.lit("VOID")) == "VOID"


def is_int(field: str, of: str = "kinds") -> Column:
    """A whole number; the column of that name is null if it has more than 32 bits."""
    return F.coalesce(kind(field, of) == "BIGINT", F.lit(False))


def is_number(field: str, of: str = "kinds") -> Column:
    return F.coalesce(kind(field, of).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def is_string(field: str, of: str = "kinds") -> Column:
    return F.coalesce(kind(field, of) == "STRING", F.lit(False))


def documents(texts: DataFrame, arrays: bool = False) -> DataFrame:
    """trace_id, events (null if the document is none), other fields of the document.

    `arrays` also takes documents that are a bare array of events.
    """
    out = texts.select("trace_id", F.from_json("text", _DOCUMENT).alias("d"), *([F.col("text")] if arrays else []))
    events: Column = F.col("d.traceEvents")
    if arrays:
        events = F.when(F.ltrim("text").startswith("["), F.from_json("text", _EVENT)).otherwise(events)
    return out.select("trace_id", events.alias("events"), *[F.col(f"d.{c.split(' ')[0]}") for c in _DOCUMENT.split(", ")[1:]])


def all_events(docs: DataFrame) -> DataFrame:
    """(trace_id, raw_pos, doc_error, epoch, e): the events of each document in their order, one document behind the other; one row without raw_pos for a document that has none, or an error."""
    events = F.when(F.col("error").isNull(), F.col("events"))
    epoch = F.expr("try_variant_get(beginningOfTime, '$', 'double')")
    return docs.select("trace_id", F.col("error").alias("doc_error"), epoch.alias("epoch"), F.posexplode_outer(events).alias("raw_pos", "e"))


def raw_events(ev: DataFrame, *more: str) -> DataFrame:
    """A row an event (trace_id, raw_pos, e): trace_id, raw_pos, `more`, its fields (null where absent or of another type), kinds, arg_kinds.

    kinds and arg_kinds have the JSON types of the fields and of the fields of args, so
    that checks look names up instead of walking the event again.
    """
    ev = ev.select("trace_id", "raw_pos", *more, F.expr("try_variant_get(e, '$', 'map<string,variant>')").alias("m"))
    ev = ev.withColumn("a", F.expr("try_variant_get(try_element_at(m, 'args'), '$', 'map<string,variant>')"))
    types = lambda c: F.transform_values(c, lambda _, v: F.schema_of_variant(v))
    get = lambda name, kind_, of="m", alias=None: F.expr(f"try_variant_get(try_element_at({of}, '{name}'), '$', '{kind_}')").alias(alias or name)
    fields = [("ph", "string"), ("pid", "int"), ("tid", "int"), ("ts", "double"), ("dur", "double"), ("tdur", "double"), ("tts", "double"), ("name", "string"), ("sf", "string"), ("stack", "array<string>"), ("esf", "string"), ("estack", "array<string>")]
    return ev.select(
        "trace_id", "raw_pos", *more, *[get(n, k) for n, k in fields], categories(get("cat", "string")).alias("cat"),
        get("detail", "string", "a"), get("name", "string", "a", "named"), get("count", "bigint", "a"), types("m").alias("kinds"), types("a").alias("arg_kinds"),
    )


def malformed() -> Column:
    """Whether a required field lacks, or a field has a type that it cannot have: no reader of the format would take the event."""
    opt = lambda check, f: absent(f) | check(f)
    whole = lambda f: is_int(f) & F.col(f).isNotNull()
    common = opt(is_number, "tts") & opt(is_string, "cat")
    duration = whole("pid") & whole("tid") & is_number("ts") & opt(is_string, "name") & (absent("args") | F.col("arg_kinds").isNotNull()) & common
    own = (
        F.when(F.col("name").isin("process_name", "thread_name"), is_string("name", "arg_kinds"))
        .when(F.col("name") == "process_labels", is_string("labels", "arg_kinds"))
        .when(F.col("name").isin("process_sort_index", "thread_sort_index"), is_int("sort_index", "arg_kinds"))
        .otherwise(False)
    )
    needs, may = F.when(F.col("name").startswith("process"), whole("pid")).otherwise(whole("tid")), F.when(F.col("name").startswith("process"), absent("tid") | whole("tid")).otherwise(absent("pid") | whole("pid"))
    meta = own & needs & may & opt(is_number, "ts") & common
    well = F.when(F.col("ph") == "X", duration & is_number("dur") & opt(is_number, "tdur")).when(F.col("ph").isin("B", "E"), duration).when(F.col("ph") == "M", meta)
    return ~F.coalesce(is_string("ph") & well, F.lit(False))


def categories(cat: Column) -> Column:
    """A comma list as an array without empty items."""
    return F.filter(F.split(cat, ","), lambda x: x != "")


def stack_frame_id(frame: Column) -> Column:
    """Frame ids are numbers or texts; all are taken as texts."""
    return frame.cast("string")
