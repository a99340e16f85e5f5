import json
import random

import pytest
from pyspark.sql import functions as F

from buildlens.operators import documents, validate
from buildlens.operators.validate import TraceError, load
from buildlens.sources.examples import EXAMPLES as CASES
from buildlens.sources.examples import NAME, SPAN, STAT, THREAD, doc

@pytest.fixture(scope="module")
def loaded(spark):
    return load(spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "trace_id string, text string"))


def test_errors(loaded):
    got = {r["trace_id"]: (r["error"], r["detail"]) for r in loaded.rejects.collect()}
    assert got == {k: v[1:] for k, v in CASES.items() if v[1]}


def test_good_traces(loaded):
    got = {r["trace_id"]: r for r in loaded.traces.collect()}
    assert set(got) == {k for k, v in CASES.items() if not v[1]}
    assert (got["good"]["pid"], got["good"]["thread_name"], got["good"]["beginning_of_time"]) == (42, "clang", 42.0)
    assert got["good_old"]["pid"] is None and got["good_old"]["beginning_of_time"] is None
    spans = {r["trace_id"]: r for r in loaded.forest.collect()}
    assert spans["good_unknown"]["arg_type"] == "CppEntity" and not spans["good_unknown"]["known"] and spans["good_optional"]["detail"] is None
    assert [(r["name"], r["count"]) for r in loaded.global_stats.collect()] == [("Frontend", 2)]


def test_strict_and_arrays(spark):
    df = spark.createDataFrame([("a", json.dumps([SPAN, NAME]))], "trace_id string, text string")
    assert load(df).rejects.first()["error"] == "CtfParseError"
    assert load(df, arrays=True).forest.count() == 1
    with pytest.raises(TraceError, match="CtfParseError"):
        load(df, strict=True)
    assert load(df.limit(0)).forest.count() == 0


def test_documents_are_read_without_a_shuffle(spark):
    """A document is read, checked and nested where it is: no window, join or exchange of its events."""
    texts = spark.createDataFrame([("a", doc(SPAN, STAT, NAME, THREAD))], "trace_id string, text string")
    plan = load(texts).forest._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not [word for word in ("hashpartitioning", "Window", "SortMergeJoin") if word in plan]


def odd_documents(rng):
    """Documents that are right, nearly right or wrong, in many spellings."""
    out = {f"{k} {name}": text for name, (text, _, _) in CASES.items() for k in ("as it is",)}
    good = [SPAN | {"ts": 3 + k, "dur": 0.25 * k, "name": name, "args": {"detail": detail}} for k, (name, detail) in enumerate([("Source", "/é/表.h"), ("New", 'a "b" \\ c'), ("New", "main"), ("LICMPass", "<unnamed loop>"), ("New", "")])]
    good = sorted(good, key=lambda e: e["ts"] + e["dur"])
    changes = [
        {"ts": 1e999}, {"ts": 10**20}, {"ts": -1}, {"ts": "3"}, {"ts": None}, {"ts": 1}, {"ts": 0}, {"ts": 3.5e0}, {"dur": True}, {"dur": 10**12}, {"pid": 42.0}, {"pid": 2**31}, {"pid": 2**63}, {"tid": 41}, {"tid": True}, {"name": 3}, {"name": None}, {"name": "Frontend"},
        {"name": "Source", "args": {}}, {"name": "LICMPass", "args": {}}, {"args": None}, {"args": []}, {"args": {"detail": None}}, {"args": {"detail": "x", "more": 1}}, {"args": {"other": 1}}, {"cat": ""}, {"cat": None}, {"tts": 1}, {"sf": "1"}, {"odd": 1}, {"ph": "B"}, {"ph": 5}, {"ph": None},
    ]
    for k, change in enumerate(changes):
        at = rng.randrange(len(good))
        out[f"changed {k}"] = doc(*good[:at], good[at] | change, *good[at + 1 :], NAME)
        out[f"added {k}"] = doc(*good, NAME, STAT | change, THREAD)
        out[f"named {k}"] = doc(*good, NAME | change)
        out[f"lacks {k}"] = doc({n: v for n, v in good[at].items() if n != rng.choice(list(good[at]))}, NAME)
    for k in range(40):
        spans = [SPAN | {"ts": rng.randint(2, 9), "dur": rng.randint(0, 5)} for _ in range(rng.randint(0, 6))]
        spans = sorted(spans, key=lambda e: (e["ts"] + e["dur"], -e["ts"])) if k % 4 else spans
        out[f"random {k}"] = doc(*spans, NAME, *rng.sample([STAT, STAT | {"name": "Total Source"}, STAT, THREAD, NAME], rng.randint(0, 2)), **rng.choice([{}, {"beginningOfTime": rng.choice([5, 5.5, None, "x", 10**20])}, {"other": 1}, {"displayTimeUnit": "ms"}]))
    text = doc(*good, NAME, STAT, THREAD, beginningOfTime=7)
    plain = doc(SPAN, NAME)
    spelled = [
        text, json.dumps(json.loads(text), ensure_ascii=False), json.dumps(json.loads(text), indent=2), " \n" + text + "\n", text + " x", text + "}", text[:-1], "\ufeff" + text, plain.replace('"', "'"), plain.replace('"ts": 5', '"ts": 5, "ts": 6'), plain.replace('"ph": "X"', '"ph": "X", "ph": "X"'),
        plain.replace('"ts": 5', '"ts": NaN'), plain.replace('"ts": 5', '"ts": 05'), plain.replace('"ts": 5', '"ts": 5.0000000000000001e0'), plain.replace('"ts": 5', '"ts": 123456789012.123456789'), plain.replace("Frontend", "Fr\u0001ontend"), plain.replace("Frontend", "A\\ud83d\\ude00"), plain.replace("Frontend", "A\\ud83d"),
        plain.replace("Frontend", "A\\u0041\\n"), plain.replace("Frontend", "Total X"), "[" + plain + "]", json.dumps([SPAN, NAME]), " " + json.dumps([SPAN, NAME]), json.dumps([]), "[1]", '{"traceEvents": [1]}', '{"traceEvents": 1}', '{"traceEvents": null}', "null", "", " ", None, '{"traceEvents": [], "traceEvents": [' + json.dumps(NAME) + "]}",
    ]
    return out | {f"spelled {k}": text for k, text in enumerate(spelled)}


@pytest.mark.parametrize("arrays", [False, True])
def test_plain_documents_as_checked_ones(spark, monkeypatch, arrays):
    """Documents that are read at once have the rows that the checks of events give, in one task or by windows."""
    texts = spark.createDataFrame(list(odd_documents(random.Random(4)).items()), "trace_id string, text string")

    def told(found):
        return [sorted((tuple(map(str, r)) for r in f.select(sorted(f.columns)).collect())) for f in (found.traces, found.forest, found.global_stats, found.rejects)]

    plain = load(texts, arrays=arrays)
    left = plain.held[0].where("kind = -1").collect()
    read = texts.count() - sum(documents.read_back(bytes(r["data"])).num_rows for r in left)
    monkeypatch.setattr(documents, "PLAIN_BYTES", 0)
    checked = load(texts, arrays=arrays)
    docs = validate.documents(texts, arrays)
    docs = docs.withColumn("error", validate.document_error(docs))
    windows = validate._load(docs, docs.where("error is null").select("trace_id", F.posexplode("events").alias("raw_pos", "e")), False)
    assert read > 25 and checked.held[0].where("kind >= 0").count() == 0
    want = told(windows)
    assert told(checked) == want and told(plain) == want
