"""Trace documents that one task holds, read in one pass.

`plain_documents` reads texts.  It takes only documents of the plain form that compilers write, in which nothing is wrong,
and leaves all others as they are; what it takes, the checks of `validate` take too, with the same rows.

`whole_documents` reads events, in the order of their documents and with the errors that each has by itself:
what hangs on their order, over all documents of a batch in numpy, and nesting.  Each good document's spans take one stack.
"""

from __future__ import annotations

import gc
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from buildlens.operators.brackets import read_back, stacked, written

_LATE, _STAT, _PROCESS, _THREAD, _OWN, _PID = range(1, 7)
_ERRORS = {_LATE: "ActivityTreeError", _STAT: "DuplicateGlobalStat", _PROCESS: "DuplicateProcessName", _THREAD: "DuplicateThreadName", _PID: "InconsistentPid"}


#: What the passes give: rows of one kind, packed as Arrow, of which few columns hold most; their frames are held so.
PACKED = pa.schema([("kind", pa.int32()), ("data", pa.binary())])
_ROWS = 1 << 16


def _filled(schema: pa.Schema) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Rows of one kind, packed, of the types in the schema."""

    def filled(kind: int, columns: dict[str, object], n: int) -> Iterator[pa.RecordBatch]:
        types = {f.name: f.type for f in schema}
        typed = {name: pa.array(c, types[name]) if isinstance(c, list) else c.cast(types[name]) for name, c in columns.items()}
        rows = pa.table(typed)
        for at in range(0, n, _ROWS):
            yield pa.record_batch([pa.array([kind], pa.int32()), pa.array([written(rows.slice(at, _ROWS))], pa.binary())], schema=PACKED)

    return filled


def unpacked(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of `data`; columns that a pack lacks are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["data"]:
                rows = read_back(data.as_py())
                columns = [rows[f.name].cast(f.type) if f.name in rows.column_names else pa.nulls(rows.num_rows, f.type) for f in schema]
                yield from pa.Table.from_arrays(columns, schema=schema).to_batches()

    return run


def whole_documents(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows of kind 0 for documents (raw_pos, error and detail of the first error, or their metadata), and of good ones kind 1 for spans, 2 for statistics."""
    filled = _filled(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            begins = np.flatnonzero(pc.fill_null(batch["raw_pos"], 0).to_numpy(zero_copy_only=False) == 0)
            if len(begins) and held or len(begins) > 1:  # the last document may go on
                yield from _read(pa.Table.from_batches([*held, batch.slice(0, begins[-1])]).combine_chunks(), filled)
                held = [batch.slice(begins[-1])]
            else:
                held.append(batch)
        if held:
            yield from _read(pa.Table.from_batches(held).combine_chunks(), filled)

    return run


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    """Null is NaN."""
    return np.asarray(column.cast(pa.float64()).to_numpy(), dtype=np.float64)


def _first(doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The first of the rows `at` in each of n documents, -1 for none."""
    out = np.full(n, -1)
    out[doc[at[::-1]]] = at[::-1]
    return out


def _read(rows: pa.Table, filled: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    raw = pc.fill_null(rows["raw_pos"], -1).to_numpy()
    begins = np.flatnonzero(raw <= 0)
    n, doc = len(begins), np.cumsum(raw <= 0) - 1
    if (raw > 0).any() and not np.array_equal(raw[raw > 0], raw[np.flatnonzero(raw > 0) - 1] + 1):
        raise ValueError("the events of a document don't follow each other")
    real = raw >= 0
    of = {r: np.flatnonzero(real & pc.fill_null(pc.equal(rows["route"], r), False).to_numpy()) for r in ("span", "stat", "process_name", "thread_name", "UnexpectedEvent", "UnexpectedMetadataEvent")}
    pid, start, duration = _doubles(rows["pid"]), _doubles(rows["ts"]), _doubles(rows["dur"])
    end = start + duration

    # the first error that each event has, by what precedes
    error = np.zeros(len(raw), np.int8)
    spans = of["span"]
    same = doc[spans[1:]] == doc[spans[:-1]]
    error[spans[1:][same & (end[spans[1:]] < end[spans[:-1]])]] = _LATE
    seen = set()
    for at, name in zip(of["stat"].tolist(), rows["name"].take(pa.array(of["stat"])).to_pylist()):
        if (doc[at], name) in seen:
            error[at] = _STAT
        seen.add((doc[at], name))
    for name, code in (("process_name", _PROCESS), ("thread_name", _THREAD)):
        error[of[name][1:][doc[of[name][1:]] == doc[of[name][:-1]]]] = code
    error[real & pc.is_valid(rows["own"]).to_numpy()] = _OWN
    with_pid = real & ~np.isnan(pid)
    strange = np.zeros(len(raw), bool)
    strange[of["UnexpectedEvent"]] = True
    first_pid = _first(doc, np.flatnonzero(with_pid & ~strange), n)
    error[with_pid & (first_pid[doc] >= 0) & (pid != pid[first_pid[doc]])] = _PID
    error[of["UnexpectedEvent"]] = error[of["UnexpectedMetadataEvent"]] = _OWN

    # one error a document
    value = lambda name, at: rows[name][int(at)].as_py()
    found: list[tuple[int | None, str | None, str | None]] = [(None, e, None) for e in rows["doc_error"].take(pa.array(begins)).to_pylist()]
    bad = _first(doc, np.flatnonzero(error), n)
    for d in np.flatnonzero(bad >= 0).tolist():
        at = int(bad[d])
        detail = value("own_detail", at)
        found[d] = (int(raw[at]), value("own", at) if error[at] == _OWN else _ERRORS[error[at]], "UnexpectedActivityOrder" if detail is None and error[at] == _LATE else detail)
    for d in doc[real & pc.fill_null(rows["malformed"], False).to_numpy()].tolist():
        found[d] = (None, "CtfParseError", None)

    good = np.array([f[1] is None for f in found])
    spans = spans[good[doc[spans]]]
    sizes = np.diff(np.searchsorted(spans, [*begins, len(raw)]))
    columns, over, free = nested(start[spans], duration[spans], sizes)
    process, thread = _first(doc, of["process_name"], n), _first(doc, of["thread_name"], n)
    for d in doc[spans[over]].tolist():
        found[d] = (None, "ActivityTreeError", "PartialActivityOverlap")
    for d in np.flatnonzero(process < 0).tolist():
        if found[d][1] is None:
            found[d] = (None, "NoProcessName", None)
    good = np.array([f[1] is None for f in found])

    taken = lambda name, at: rows[name].take(pa.array(at, mask=at < 0))
    told = {name: [f[k] for f in found] for k, name in enumerate(("raw_pos", "error", "detail"))}
    told |= {"process_name": taken("named", process), "thread_name": taken("named", thread), "pid": taken("pid", _first(doc, np.flatnonzero(with_pid), n))}
    yield from filled(0, told | {"trace_id": taken("trace_id", begins), "beginning_of_time": taken("epoch", begins)}, n)

    keep = np.flatnonzero(good[doc[spans]])
    columns = {name: pa.array(x[keep], mask=free[keep] if name.startswith("parent") else None) for name, x in columns.items()}
    at = spans[keep]
    yield from filled(1, columns | {"trace_id": taken("trace_id", at), "activity": taken("name", at), "catalogue_type": taken("catalogue_type", at), "detail": taken("detail", at)}, len(at))

    at = of["stat"][good[doc[of["stat"]]]]
    yield from filled(2, {"trace_id": taken("trace_id", at), "activity": taken("name", at), "duration": taken("dur", at), "count": taken("count", at)}, len(at))


def nested(start: np.ndarray, duration: np.ndarray, sizes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Columns of the spans of documents, which have so many each; which spans begin inside earlier ones, and which have no parent."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    base = np.repeat(bounds[:-1], sizes)
    parts = [stacked(start[a:b], b - a) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if a < b]
    up, depth, first = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    end, before = start + duration, base + np.where(first > 0, first - 1, 0)
    free, above = up < 0, base + np.maximum(up, 0)
    n_children = np.bincount(above[~free], minlength=len(start))
    busy = np.bincount(above[~free], weights=duration[~free], minlength=len(start))
    columns = {
        "pos": np.arange(len(start)) - base, "first_pos": np.maximum(first, 0), "depth": depth, "parent_pos": np.maximum(up, 0), "parent_duration": duration[above], "n_children": n_children, "start": start, "duration": duration,
        "self_duration": duration - busy,
    }
    return columns, (first > 0) & (end[before] > start), free


#: Bytes of a text that is read at once, and spans that are held at once.
PLAIN_BYTES, PLAIN_SPANS = 16 << 20, 1 << 16
_INT, _BIGINT = 1 << 31, 1 << 63


class NotPlain(ValueError):
    """The document may be wrong, or right in a way that is left to the checks of `validate`."""


def _object(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise NotPlain("a key twice")
    return out


def _no_constant(name: str) -> None:
    raise NotPlain(name)


_ONCE = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_no_constant)
_FAST = json.JSONDecoder(parse_constant=_no_constant)
_INF = math.inf


def _number(x: object) -> float:
    if type(x) is float and -_INF < x < _INF or type(x) is int and -_BIGINT <= x < _BIGINT:
        return float(x)
    raise NotPlain("no number")


def plain_document(data: bytes, types: dict[str, str], arrays: bool) -> tuple[list[tuple], list[tuple], tuple]:
    """(activity, detail, type, start, duration) of spans, (name, duration, count) of statistics, (process_name, pid, thread_name, beginning_of_time).

    Raises ValueError, KeyError or TypeError where a document is not plain.  Every event has as many fields as it needs, so
    that one more would lack another.  In a text without escapes the number of quotes tells whether a key comes twice.
    """
    if b"\\ud" in data or b"\\uD" in data:
        raise NotPlain("perhaps half a character")
    escapes = b"\\" in data
    document = (_ONCE if escapes else _FAST).decode(data.decode())
    quotes = 0
    if type(document) is list and arrays and data.lstrip(b" ").startswith(b"["):
        document = {"traceEvents": document}
        quotes -= 2
    events = document["traceEvents"] if type(document) is dict else None
    if type(events) is not list or len(document) != 1 + ("beginningOfTime" in document):
        raise NotPlain("other fields")
    epoch = _number(document["beginningOfTime"]) if "beginningOfTime" in document else None
    quotes += 2 * len(document)
    spans, stats, names, totals, first, last = [], [], {}, set(), None, -_INF
    for event in events:
        if type(event) is not dict:
            raise NotPlain("no event")
        ph, pid, tid, name, ts, n = event["ph"], event["pid"], event["tid"], event["name"], event["ts"], len(event)
        if type(ts) is not float or not -_INF < ts < _INF:
            ts = _number(ts)
        if pid != first or tid != first:
            first = pid if first is None else first
            if pid != first or not (-_INT <= pid < _INT and -_INT <= tid < _INT):
                raise NotPlain("another process")
        if not (type(pid) is type(tid) is int and type(name) is str):
            raise NotPlain("fields of another kind")
        if ph == "X":
            duration = event["dur"]
            if type(duration) is not float or not -_INF < duration < _INF:
                duration = _number(duration)
            args = event["args"] if n == 7 else None
            if n != 6 and type(args) is not dict:
                raise NotPlain("other fields")
            if ts > 1.0:
                kind = types.get(name)
                if args:
                    detail = args["detail"]
                    if len(args) > 1 or type(detail) is not str or kind == "Nothing":
                        raise NotPlain("other arguments")
                    quotes += 22
                else:
                    detail = None
                    if kind not in (None, "Nothing", "SymbolOpt", "UnnamedLoopOpt"):
                        raise NotPlain("no detail")
                    quotes += 4 + 2 * n
                end = ts + duration
                if tid != pid and not (pid == 1 and tid == 0) or end < last:
                    raise NotPlain("a wrong span")
                last = end
                spans.append((name, detail, kind, ts, duration))
            else:
                if tid == 0 or ts != 0.0 or not name.startswith("Total ") or name in totals or args is None or len(args) != 2:
                    raise NotPlain("a wrong total")
                _number(args["avg ms"])
                count = args["count"]
                if type(count) is not int or not 0 <= count < _BIGINT:
                    raise NotPlain("no count")
                totals.add(name)
                stats.append((name, duration, count))
                quotes += 22
        elif ph == "M":
            if n != 7 or name not in ("process_name", "thread_name") or name in names or not (tid == pid or name == "process_name" and pid == 1 and tid == 0):
                raise NotPlain("other metadata")
            args = event["args"]
            if ts != 0.0 or event["cat"] != "" or type(args) is not dict or len(args) != 1 or type(args["name"]) is not str:
                raise NotPlain("a wrong name")
            names[name] = args["name"]
            quotes += 24
        else:
            raise NotPlain("another event")
    if "process_name" not in names or not escapes and data.count(b'"') != quotes:
        raise NotPlain("no name, or a key twice")
    return spans, stats, (names["process_name"], first, names.get("thread_name"), epoch)


def plain_documents(schema: pa.Schema, types: dict[str, str], arrays: bool, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows as of `whole_documents`, of the documents that are plain, and of `most` bytes at most; the others have kind -1 and their text."""
    filled = _filled(schema)

    def made(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = pa.array([h[0] for h in held], schema.field("trace_id").type)
        spans = [row for h in held for row in h[2][0]]
        sizes = np.array([len(h[2][0]) for h in held])
        columns = list(zip(*spans)) or [()] * 5
        numbers, over, free = nested(np.array(columns[3], np.float64), np.array(columns[4], np.float64), sizes)
        doc = np.repeat(np.arange(len(held)), sizes)
        good = np.ones(len(held), bool)
        good[doc[over]] = False
        keep = np.flatnonzero(good[doc])
        rows = {name: pa.array(x[keep], mask=free[keep] if name.startswith("parent") else None) for name, x in numbers.items()}
        texts = {name: pa.array(columns[k], pa.string()).take(pa.array(keep)) for k, name in enumerate(("activity", "detail", "catalogue_type"))}
        yield from filled(1, rows | texts | {"trace_id": ids.take(pa.array(doc[keep]))}, len(keep))
        at = np.flatnonzero(good).tolist()
        told = {name: [held[k][2][2][i] for k in at] for i, name in enumerate(("process_name", "pid", "thread_name", "beginning_of_time"))}
        yield from filled(0, told | {"trace_id": ids.take(pa.array(at, pa.int64()))}, len(at))
        stats = [(k, *row) for k in at for row in held[k][2][1]]
        totals = {name: [row[i] for row in stats] for i, name in enumerate(("activity", "duration", "count"), 1)}
        yield from filled(2, totals | {"trace_id": ids.take(pa.array([row[0] for row in stats], pa.int64()))}, len(stats))
        yield from left([held[k][:2] for k in np.flatnonzero(~good).tolist()])

    def left(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield from filled(-1, {"trace_id": [r[0] for r in rows], "text": [r[1] for r in rows]}, len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, others, size = [], 0, [], 0
        gc.disable()  # what is parsed has no cycles
        for batch in batches:
            ids, texts = batch["trace_id"], batch["text"]
            texts = texts.cast(pa.binary())
            for k in range(batch.num_rows):
                data = texts[k].as_py()
                try:
                    if data is None or len(data) > most:
                        raise NotPlain("no text, or a large one")
                    read = plain_document(data, types, arrays)
                except (ValueError, KeyError, TypeError, RecursionError):
                    others.append((ids[k].as_py(), data))
                    size += len(data or b"") + 100
                    if size >= 1 << 20:
                        yield from left(others)
                        others, size = [], 0
                    continue
                held.append((ids[k].as_py(), data, read))
                n += len(read[0]) + 1
                if n >= PLAIN_SPANS:
                    yield from made(held)
                    held, n = [], 0
        if held:
            yield from made(held)
        yield from left(others)
        gc.enable()

    return run
