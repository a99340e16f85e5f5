"""Small trace documents, one for each error of the reader, and good ones."""

import json

NAME = {"ph": "M", "pid": 42, "tid": 42, "ts": 0, "cat": "", "name": "process_name", "args": {"name": "clang"}}
THREAD = NAME | {"name": "thread_name"}
SPAN = {"ph": "X", "pid": 42, "tid": 42, "ts": 5, "dur": 2, "name": "Frontend"}
STAT = {"ph": "X", "pid": 42, "tid": 1, "ts": 0, "dur": 2, "name": "Total Frontend", "args": {"count": 2, "avg ms": 0.1}}


def doc(*events, **more):
    return json.dumps({"traceEvents": list(events)} | more)


def args(name, a):
    return doc(SPAN | {"name": name} | ({} if a is None else {"args": a}), NAME)


#: Name: document, error (None: good), detail.
EXAMPLES = {
    "empty_object": ("{}", "CtfParseError", None),
    "no_json": ("nope", "CtfParseError", None),
    "no_events": (doc(), "NoProcessName", None),
    "bad_epoch": (doc(NAME, beginningOfTime="x"), "InvalidBeginningOfTime", None),
    "unit": (doc(NAME, displayTimeUnit="ns"), "UnexpectedTraceMetadata", None),
    "samples": (doc(NAME, samples=[]), "UnexpectedTraceMetadata", None),
    "two_pids": (doc(SPAN, NAME | {"pid": 43, "tid": 43}), "InconsistentPid", None),
    "order": (doc(SPAN, SPAN | {"ts": 2, "dur": 1}, NAME), "ActivityTreeError", "UnexpectedActivityOrder"),
    "overlap": (doc(SPAN, SPAN | {"ts": 6, "dur": 3}, NAME), "ActivityTreeError", "PartialActivityOverlap"),
    "stat_prefix": (doc(STAT | {"name": "Frontend"}, NAME), "GlobalStatParseError", "NoTotalPrefix"),
    "stat_count": (doc(STAT | {"args": {"count": 1.5, "avg ms": 1}}, NAME), "GlobalStatParseError", "UnexpectedValue"),
    "stat_key": (doc(STAT | {"args": {"count": 1}}, NAME), "GlobalStatParseError", "MissingKey"),
    "stat_more": (doc(STAT | {"args": {"count": 1, "avg ms": 1, "x": 0}}, NAME), "GlobalStatParseError", "UnexpectedKeys"),
    "stat_twice": (doc(STAT, STAT, NAME), "DuplicateGlobalStat", None),
    "at_one": (doc(SPAN | {"ts": 1.0}, NAME), "GlobalStatParseError", "UnexpectedInput"),
    "name_cat": (doc(NAME | {"cat": "x"}), "NameParseError", None),
    "name_twice": (doc(NAME, NAME), "DuplicateProcessName", None),
    "nameless": (doc(SPAN), "NoProcessName", None),
    "thread_twice": (doc(NAME, THREAD, THREAD), "DuplicateThreadName", None),
    "begin": (doc({"ph": "B", "pid": 42, "tid": 42, "ts": 5}, NAME), "UnexpectedEvent", None),
    "sort_index": (doc(NAME | {"name": "process_sort_index", "args": {"sort_index": 1}}), "UnexpectedMetadataEvent", None),
    "unknown_phase": (doc(NAME, {"ph": "Q"}), "CtfParseError", None),
    "no_duration": (doc(NAME, {"ph": "X", "pid": 42, "tid": 42, "ts": 5, "name": "x"}), "CtfParseError", None),
    "text_pid": (doc(NAME, SPAN | {"pid": "42"}), "CtfParseError", None),
    "thread_span": (doc(SPAN | {"tid": 7}, NAME), "ActivityStatParseError", "UnexpectedInput"),
    "nothing_args": (args("Frontend", {"detail": "x"}), "ActivityStatParseError", "UnexpectedKeys"),
    "missing": (args("Source", {}), "ActivityStatParseError", "MissingKey"),
    "other_key": (args("Source", {"detail": "/x", "y": 1}), "ActivityStatParseError", "UnexpectedKeys"),
    "detail_number": (args("Source", {"detail": 3}), "ActivityStatParseError", "UnexpectedValue"),
    "good_optional": (args("LICMPass", None), None, None),
    "good_unknown": (args("SomethingNew", {"detail": "std::x"}), None, None),
    "good_old": (doc(SPAN | {"pid": 1, "tid": 0}, NAME | {"pid": 1, "tid": 0}), None, None),
    "good": (doc(SPAN, STAT, NAME, THREAD, beginningOfTime=42.0, other=1), None, None),
}
