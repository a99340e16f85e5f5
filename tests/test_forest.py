import os
import random
import re

import pytest
from pyspark.sql import functions as F

from buildlens.operators import brackets, forest, profile, shared
from buildlens.plans.report import metadata_text, report
from buildlens.plans.trace import Traces, described

SPANS = "trace_id string, pos int, start double, duration double"


def stack_forest(spans):
    """(parent, first) by a stack over spans in order."""
    parent, first, stack = [None] * len(spans), [0] * len(spans), []
    for j, (start, _) in enumerate(spans):
        while stack and spans[stack[-1]][0] >= start:
            parent[stack.pop()] = j
        first[j] = stack[-1] + 1 if stack else 0
        stack.append(j)
    return parent, first


def random_spans(rng, lo, hi, depth):
    """A valid forest on a coarse grid: many ties, empty spans, touching siblings."""
    out, at = [], lo
    while at <= hi and rng.random() < 0.8:
        end = rng.randint(at, hi)
        if depth:
            out += random_spans(rng, at, end, depth - 1)
        out.append((float(at), float(end - at)))
        at = end + rng.choice([0, 0, 1])
    return out


@pytest.mark.parametrize("build", [forest.build_forest, lambda s: brackets.nest_in_chunks(s, 9, sums=True)], ids=["windows", "chunks"])
def test_nesting_against_a_stack(spark, build):
    rng = random.Random(3)
    traces = {f"t{k}": random_spans(rng, 0, rng.choice([3, 6, 20]), 3) for k in range(150)}
    traces["large"] = random_spans(rng, 0, 2000, 1) + [(0.0, 2000.0 + k) for k in range(40)]
    rows = [(t, p, s, d) for t, spans in traces.items() for p, (s, d) in enumerate(spans)]
    nested = build(spark.createDataFrame(rows, SPANS))
    got = {(r["trace_id"], r["pos"]): r for r in nested.collect()}
    assert len(got) == len(rows)
    for t, spans in traces.items():
        parent, first = stack_forest(spans)
        for p, (_, d) in enumerate(spans):
            r = got[t, p]
            assert (r["parent_pos"], r["first_pos"]) == (parent[p], first[p]), (t, p, spans)
            inner = [spans[c][1] for c in range(len(spans)) if parent[c] == p]
            assert r["self_duration"] == d - sum(inner) and r["n_children"] == len(inner) and r["n_descendants"] == p - first[p]
            assert r["depth"] == (got[t, parent[p]]["depth"] + 1 if parent[p] is not None else 0)
    assert forest.overlapping_traces(nested).count() == 0


def test_one_trace_goes_to_all_chunks(spark):
    """A single trace over many tasks: parents beyond their chunk, and spans that stay open over several."""
    rng = random.Random(8)
    spans = []
    for k in range(60):
        spans += [(10.0 * k + s, d) for s, d in random_spans(rng, 0, 9, 2)]
        if k % 10 == 9:
            spans.append((10.0 * (k - 9), 99.0))
    spans += [(0.0, 600.0), (0.0, 700.0)]
    frame = spark.createDataFrame([("one", p, s, d) for p, (s, d) in enumerate(spans)], SPANS)
    got = {r["pos"]: r for r in brackets.nest_in_chunks(frame, 13).collect()}
    want = {r["pos"]: r for r in forest.nest(frame).collect()}
    parent, first = stack_forest(spans)
    columns = ["end", "depth", "first_pos", "parent_pos", "parent_duration", "n_descendants"]
    assert len(got) == len(spans) and all([got[p][c] for c in columns] == [want[p][c] for c in columns] for p in got)
    assert all((got[p]["parent_pos"], got[p]["first_pos"]) == (parent[p], first[p]) for p in got)
    rows = forest.axis(frame).repartitionByRange(13, "trace_id", "__point").groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 6 and max(r["count"] for r in rows) < len(spans)
    assert brackets.nest_in_chunks(frame.limit(0), 4).count() == 0


def folder_size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_one_trace_takes_little_disk(spark):
    """A trace is written once, packed, not span by span and with both its ends."""
    folder = spark.sparkContext.getCheckpointDir() or shared.shared_folder(spark)
    hundredth = "id % 100 = 99"
    spans = spark.range(60_000).selectExpr("'one' trace_id", "cast(id as int) pos", f"cast(if({hundredth}, id - 99, id) as double) start", f"cast(if({hundredth}, 100, 1) as double) duration")
    before = folder_size(folder.removeprefix("file:"))
    nested = brackets.nest_in_chunks(spans, 6)
    assert nested.count() == 60_000
    assert 0 < folder_size(folder.removeprefix("file:")) - before < 30 * 60_000


@pytest.mark.parametrize("most", [1, 3, 50])
def test_blocks_against_windows(spark, monkeypatch, most):
    """Blocks of few spans: chains open over many of them, ends of traces within, overlaps, spans that come without numbers."""
    monkeypatch.setattr(brackets, "BLOCK_ROWS", most)
    rng = random.Random(most)
    traces = {f"t{k}": random_spans(rng, 0, rng.choice([3, 20, 60]), 4) for k in range(25)}
    traces["deep"] = [(float(300 - k // 2), float(k)) for k in range(200)]
    bad = {f"t{k}": sorted(((float(s), float(rng.randint(0, 5))) for s in (rng.randint(0, 9) for _ in range(12))), key=lambda x: x[0] + x[1]) for k in range(90, 110)}
    rows = [(t, p, s, d) for t, spans in {**traces, **bad}.items() for p, (s, d) in enumerate(spans)]
    frame = spark.createDataFrame(rows, SPANS)
    got, want = brackets.nest_in_chunks(frame, 3), forest.nest(frame)
    assert got.count() == len(rows) and {r[0] for r in forest.overlapping_traces(got).collect()} == {r[0] for r in forest.overlapping_traces(want).collect()} != set()
    columns = ["trace_id", "pos", "start", "duration", "end", "depth", "first_pos", "parent_pos", "parent_duration", "n_descendants"]
    told = lambda f: sorted(map(tuple, f.where(F.col("trace_id").isin(*traces)).select(*columns).collect()), key=lambda r: r[:2])
    assert told(got) == told(want)
    numbered = brackets.nest_in_chunks(frame.withColumnRenamed("pos", "nth"), 3, order=[F.col("start") + F.col("duration"), "nth"])
    assert "nth" not in numbered.columns and told(numbered) == told(want)


def test_overlaps_and_order(spark):
    rng = random.Random(5)
    rows, bad = [], set()
    for k in range(120):
        spans = sorted(((float(s), float(rng.randint(0, 5))) for s in (rng.randint(0, 8) for _ in range(rng.randint(0, 5)))), key=lambda x: x[0] + x[1])
        rows += [(f"t{k}", p, s, d) for p, (s, d) in enumerate(spans)]
        for j, (s, _) in enumerate(spans):
            if any(a < s < a + b for a, b in spans[:j]):
                bad.add(f"t{k}")
    df = spark.createDataFrame(rows, SPANS)
    assert {r[0] for r in forest.overlapping_traces(forest.nest(df)).collect()} == bad
    last = {(t, p): max((q for u, q, a, b in rows if u == t and q < p and a < s < a + b), default=None) for t, p, s, _ in rows}
    assert {(r["trace_id"], r["pos"]): r["earlier_pos"] for r in forest.overlaps(df).collect()} == {k: v for k, v in last.items() if v is not None}
    assert {t for t, _ in (k for k, v in last.items() if v is not None)} == bad
    assert forest.order_errors(spark.createDataFrame([("a", 0, 7.0, 2.5), ("a", 1, 1.5, 3.0)], SPANS)).count() == 1
    assert forest.order_errors(df).count() == 0


def test_known_forest(spark):
    rows = [("Parse", 20.0, 700.0), ("Read", 10.0, 750.0), ("Emit", 805.0, 40.0), ("Write", 800.0, 60.0), ("Run", 5.0, 900.0)]
    df = spark.createDataFrame([("t", p, s, d, a) for p, (a, s, d) in enumerate(rows)], SPANS + ", activity string")
    f = forest.build_forest(df)
    got = {r["pos"]: (r["parent_pos"], r["first_pos"]) for r in f.collect()}
    assert got == {0: (1, 0), 1: (4, 0), 2: (3, 2), 3: (4, 2), 4: (None, 0)}
    assert [r["pos"] for r in forest.ancestors(f, forest.span_at(f, 0)).orderBy("pos").collect()] == [1, 4]
    assert {r["pos"] for r in forest.zoom(f, 4).collect()} == {1, 3}
    assert {r["pos"] for r in forest.zoom(f, 4, flat=True).collect()} == {0, 1, 2, 3}
    assert {r["pos"] for r in forest.leaves(f).collect()} == {0, 2}
    assert [r["activity"] for r in profile.activity_breakdown(f).orderBy("self_duration", ascending=False).collect()][0] == "Parse"
    order = [r["pos"] for r in profile.tree_order(profile.hierarchical_profile(f, 0.05)).orderBy("place").collect()]
    assert order == [4, 1, 0, 3]
    with pytest.raises(ValueError):
        profile.profile(f, mode="round")
    assert profile.profile(f.withColumn("detail", f.activity), "flat", "global", 50.0).count() == 1


def test_relatives_against_all_pairs(spark):
    rng = random.Random(21)
    rows = [(f"t{k}", p, s, d) for k in range(20) for p, (s, d) in enumerate(random_spans(rng, 0, 400, 6))]
    nested = forest.nest(spark.createDataFrame(rows, SPANS))
    spans = [(r["trace_id"], r["first_pos"], r["pos"]) for r in nested.collect()]
    want = {(t, a, p) for t, first, a in spans for u, _, p in spans if t == u and first <= p < a}
    below = [(r["trace_id"], r["ancestor_pos"], r["pos"]) for r in forest.descendants(nested, nested).collect()]
    above = [(r["trace_id"], r["pos"], r["below_pos"]) for r in forest.ancestors(nested, nested).collect()]
    assert len(below) == len(above) == len(want) and set(below) == set(above) == want and max(p for _, _, p in spans) > 40


def test_process_trees(spark):
    """A chain deeper than any fixed bound of rounds, a cycle, and an orphan."""
    rows = [("a", k, k - 1) for k in range(2, 90)] + [("b", 1, 3), ("b", 2, 1), ("b", 3, 2), ("b", 9, 8), ("c", 5, 1)]
    got = {tuple(r) for r in forest.process_trees(spark.createDataFrame(rows, "job string, pid bigint, ppid bigint"), spark.createDataFrame([("a", 1), ("b", 1)], "job string, pid bigint")).collect()}
    assert got == {("a", k) for k in range(1, 90)} | {("b", k) for k in (1, 2, 3)}


def test_empty_forest(spark):
    f = forest.build_forest(spark.createDataFrame([], SPANS + ", activity string"))
    assert f.count() == 0 and profile.activity_breakdown(f).count() == 0
    assert profile.remainder(f, "duration", 1.0).first()[0] == 0


def trace(events):
    import json

    return json.dumps({"traceEvents": events, "beginningOfTime": 1656508702311015})


def told(spans, parent, least):
    """(pos or number of hidden, depth) in the order of a report, by recursion."""
    out, total = [], sum(d for p, (_, d) in enumerate(spans) if parent[p] is None)

    def tell(above, depth):
        kids = [p for p in range(len(spans)) if parent[p] == above]
        shown = sorted((p for p in kids if total and spans[p][1] / total >= least), key=lambda p: (-spans[p][1], p))
        for p in shown:
            out.append((p, depth))
            tell(p, depth + 1)
        if len(shown) < len(kids):
            out.append((f"{len(kids) - len(shown)} hidden", depth))

    tell(None, 0)
    return out


def test_order_of_reports(spark):
    rng = random.Random(12)
    traces = {f"t{k}": random_spans(rng, 0, rng.choice([4, 9, 30]), 4) for k in range(60)}
    rows = [(t, p, s, d, f"a{p}") for t, spans in traces.items() for p, (s, d) in enumerate(spans)]
    built = forest.build_forest(spark.createDataFrame(rows, SPANS + ", activity string")).cache()
    for least in (0.0, 0.1, 0.3):
        got = {}
        for r in profile.report_tree(built, least, ["trace_id"]).orderBy("trace_id", "place").collect():
            got.setdefault(r["trace_id"], []).append((r["place"], (r["pos"] if r["n_hidden"] == 0 else f"{r['n_hidden']} hidden", r["depth"])))
        for t, spans in traces.items():
            want = told(spans, stack_forest(spans)[0], least)
            assert [x for _, x in got.get(t, [])] == want and [p for p, _ in got.get(t, [])] == list(range(len(want)))
    built.unpersist()


def test_order_of_a_deep_tree(spark):
    """One chain of 20,000 spans: no step of a level at a time."""
    chain = spark.range(20_000).selectExpr("'deep' trace_id", "cast(id as int) pos", "cast(20000 - id as double) start", "cast(2 * id + 1 as double) duration")
    nested = forest.nest(chain)
    assert nested.agg(F.max("depth")).first()[0] == 19_999
    assert profile.tree_order(nested).where("place <> 19999 - pos").count() == 0


def test_report(spark, tmp_path):
    x = lambda name, ts, dur, **a: {"ph": "X", "pid": 42, "tid": 42, "ts": ts, "dur": dur, "name": name} | ({"args": a} if a else {})
    events = [
        x("Source", 3, 900, detail="/usr/include/c++/12/bits/stl_vector.h"), x("InstantiateClass", 1000, 2000, detail="std::map<std::string, std::vector<int> >"), x("Frontend", 2, 4000), x("ExecuteCompiler", 1.5, 10_000_000),
        {"ph": "X", "pid": 42, "tid": 1, "ts": 0, "dur": 900, "name": "Total Source", "args": {"count": 1, "avg ms": 0.9}},
        {"ph": "M", "pid": 42, "tid": 42, "ts": 0, "cat": "", "name": "process_name", "args": {"name": "clang-17.0.6"}},
    ]
    (tmp_path / "t.json").write_text(trace(events))
    traces = Traces.read(spark, str(tmp_path / "t.json"))
    text = report(traces, 0.01, 0.01, 80)
    assert text.startswith("Data from clang-17.0.6, pid 42, recorded 2022-06-29T13:18:22.311015Z.")
    assert "- ExecuteCompiler [10.00s, 100.00%]" in text and "  - Frontend [4.00ms, 0.04%]" in text
    assert "1 other children" not in text.split("ExecuteCompiler [10.00s")[0]
    assert traces.loaded.global_stats.collect()[0]["average_duration"] == 900
    rows = {r["activity"]: r["description"] for r in described(traces.spans, 40).collect()}
    assert rows["Frontend"] == "Frontend" and rows["InstantiateClass"] == "InstantiateClass(std::map<…>)" and len(rows["Source"]) <= 40
    assert described(traces.spans, 5).where("description is not null").count() == 0
    traces.loaded.release()


@pytest.mark.parametrize("cols, lines", [(89, 1), (88, 2), (51, 2), (50, 3), (37, 3), (22, 1)])
def test_metadata_wraps(cols, lines):
    text = metadata_text("clang-17.0.6", 5884, "clang++", 1656508702311015.0, cols)
    assert text.count("\n") == lines - 1 and (text == "…") == (cols == 22)


def test_tasks_grow_with_the_tables(spark, small, monkeypatch):
    """What a task holds of the table spans stays the same: their partitions follow the number of rows."""
    from buildlens.operators import shared
    from buildlens.sources.tables import table_spans

    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    spans = table_spans(spark, small)
    held = [r[0] for r in forest.build_forest(spans).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(held) > 8 and sum(held) == spans.count() and max(held) < 1500


NAMED = ["tree4_self_duration", "tree9_children", "tree11_parent", "tree12_has_children", "tree13_leaves", "tree15_zoom", "win2_pct_parent", "agg1_norm", "agg2_percent_norm", "agg3_type_breakdown", "agg5_counts", "agg6_children_duration", "top4_type_cut", "flt2_remainder"]


@pytest.mark.parametrize("name", NAMED)
def test_every_shuffle_of_spans_grows_with_the_tables(spark, small, monkeypatch, name):
    """No shuffle keeps the session's number of partitions; those of sums by activity or position are made in every task before."""
    from buildlens import queries
    from buildlens.operators import shared

    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([a-z_]+)#[^)]*?, (\d+)\)", plan)
    assert len(shuffles) > 4 and "BroadcastExchange" not in plan
    assert [k for k, n in shuffles if int(n) <= 8 and k not in ("activity", "_groupingexpression", "parent_pos")] == []


def test_children_by_condition_or_frame(spark):
    rng = random.Random(5)
    rows = [(t, p, s, d) for t in "abc" for p, (s, d) in enumerate(random_spans(rng, 0, 40, 3))]
    forest_ = forest.build_forest(spark.createDataFrame(rows, SPANS))
    of = F.col("depth") == 1
    got = sorted(map(tuple, forest.children(forest_, of).select("trace_id", "pos", "parent_pos").collect()))
    assert got and got == sorted(map(tuple, forest.children(forest_, forest_.where(of)).select("trace_id", "pos", "parent_pos").collect()))
