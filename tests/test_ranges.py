"""Traces read by byte ranges, against the same files read whole."""

import json

import pytest

from buildlens.operators.validate import load, load_ranges
from buildlens.queries import QUERIES
from buildlens.sources.examples import EXAMPLES, NAME, SPAN
from buildlens.sources.ranges import event_texts
from buildlens.sources.traces import read_trace_texts

#: Details that look like the ends of objects, lists and texts.
DETAILS = ["a}b", "]}],{", '\\"}', "\\\\", '"traceEvents": [{', "{[", "é}€", "", '\\\\"', "},\n{"]
SOURCE = SPAN | {"name": "Source"}
TRICKY = [SOURCE | {"ts": k + 5, "dur": 1, "args": {"detail": "/" + d}} for k, d in enumerate(DETAILS)] + [NAME]
FILES = {name: text for name, (text, _, _) in EXAMPLES.items()} | {
    "tricky": json.dumps({"a": {"traceEvents": [1, {}]}, "beginningOfTime": 7.0, "traceEvents": TRICKY, "x": [{"y": "]}"}]}),
    "spread": json.dumps({"traceEvents": TRICKY, "z": {"b": []}}, indent=3, ensure_ascii=False) + "\n\n",
    "empty_list": '{"traceEvents":[],"beginningOfTime":1,"z":{"traceEvents":[{"ph":"X"}]}}', "not_closed": json.dumps({"traceEvents": [SPAN, NAME]})[:-1], "cut_off": json.dumps({"traceEvents": [SPAN, NAME]})[:-20],
    "comma": json.dumps({"traceEvents": [SPAN, NAME]}).replace("}, {", "},, {"), "number": '{"traceEvents":[1,' + json.dumps(NAME) + "]}", "number_behind": '{"traceEvents":[' + json.dumps(NAME) + ",1]}",
    "bare": json.dumps(TRICKY), "bare_spread": json.dumps(TRICKY, indent=1),
}


def answers(loaded):
    rejects = {(r["trace_id"].rsplit("/", 1)[1], r["error"]) for r in loaded.rejects.collect()}
    columns = ["pos", "activity", "detail", "arg_type", "start", "duration", "parent_pos", "self_duration"]
    spans = sorted((r["trace_id"].rsplit("/", 1)[1], *(r[c] for c in columns)) for r in loaded.forest.select("trace_id", *columns).collect())
    traces = sorted(((r["trace_id"].rsplit("/", 1)[1], *tuple(r)[1:]) for r in loaded.traces.collect()), key=str)
    return rejects, spans, traces, loaded.global_stats.count()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("traces")
    for name, text in FILES.items():
        (where / name).write_text(text, encoding="utf-8")
    return where


@pytest.fixture
def cut(spark):
    """Sets the size of the ranges that files are read in."""
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": None, "spark.sql.files.minPartitionNum": None}
    before = {k: spark.conf.get(k, None) for k in keys}

    def put(size):
        for k, v in (("spark.sql.files.maxPartitionBytes", size), ("spark.sql.files.openCostInBytes", 0), ("spark.sql.files.minPartitionNum", 1)):
            spark.conf.set(k, str(v))

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("arrays", [False, True])
def test_ranges_equal_whole_files(spark, folder, cut, arrays):
    want = answers(load(read_trace_texts(spark, str(folder)), arrays=arrays))
    cut(193)
    assert answers(load_ranges(spark, str(folder), arrays=arrays)) == want
    assert sum(x[0] == "tricky" for x in want[1]) == len(DETAILS) and (("bare", "CtfParseError") in want[0]) != arrays


def test_cut_at_every_byte(spark, folder, cut):
    """Ranges of every size, so that a border lies at every byte."""
    (folder / "sub").mkdir()
    text = '{"x":{},"traceEvents": [{"a":"}\\\\"},{"b":[],"c":{"d":"\\"{"}}],"y":1}'
    (folder / "sub" / "one").write_text(text)
    want = [json.dumps(e) for e in json.loads(text)["traceEvents"]]
    for size in (1, 2, 3, 7):
        cut(size)
        events, rests = event_texts(spark, str(folder / "sub" / "one"))
        assert [json.dumps(json.loads(r["text"])) for r in events.orderBy("raw_pos").collect()] == want
        assert json.loads(rests.first()["text"]) == {"x": {}, "traceEvents": [], "y": 1}


def test_a_trace_of_events_is_one_file(spark, tmp_path):
    """With partitions coalesced on both sides of a union the end of a trace was a file of its own."""
    n, before = 300_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.range(n).selectExpr("id as event_id", "id % 8 as user_id").write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert QUERIES["src1_events_by_ranges"](spark, str(tmp_path)).count() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
