import json
import os
import random

import pytest
from pyspark.sql import functions as F

from buildlens.functions import arguments, names, paths, text
from buildlens.functions.names import bounded, bounded_entity, entity_renderings
from buildlens.functions.sql import register_functions
from buildlens.operators import build, content, dictionary, resources
from buildlens.sources import units
from buildlens.streaming import samples


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["out"] for r in rows.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_durations(spark):
    m, h = 6e7, 3.6e9
    cases = {7.25: "7.25µs", 8640.0: "8.64ms", 999995.0: "1.00s", 59.995e6: "1:00.00", 17 * m + 3.141e6: "17:03.14", 23 * h + 59 * m + 59.995e6: "1d 00:00:00.00", 0.75: "0.75µs", 9.0: "9µs", 62.5e6: "1:02.50", 14 * h: "14:00:00.00"}
    assert column(spark, list(cases), "double", text.duration_text) == list(cases.values())
    assert column(spark, [None], "double", text.duration_text) == [None]


def test_fixed_rounds_by_the_binary_value(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 10**6) / 1000 for _ in range(3000)] + [0.125, 0.375, 2.675, 1.005]
    assert column(spark, values, "double", lambda c: text.fixed(c, 2)) == [f"{v:.2f}" for v in values]


def test_shortened():
    s = "the build takes longer than the tests"
    assert [text.shortened(s, c) for c in (37, 20, 4, 1)] == [s, "the build… the tests", "t…ts", "…"]
    assert text.width("日本") == 4 and text.width(text.shortened("日本語テキスト", 6)) <= 6


def test_shorten_columns(spark):
    assert column(spark, ["abcdefghij", "short", None, "日本語テキスト"], "string", lambda c: text.shorten(c, 5)) == ["ab…ij", "short", None, "日…ト"]


def test_paths(spark):
    cases = {"/a/./b//c": "/a/b/c", "/../a": "/a", "/a/../../b": "/b", "/": "/", "a/b": None}
    assert column(spark, list(cases), "string", paths.normalized) == list(cases.values())
    assert column(spark, ["a", "/a"], "string", paths.path_error) == ["RelativePath", None]
    p = ["/", "opt", "kernel", "tables.h"]
    assert [paths.shortened_path(p, c) for c in (10, 11, 15, 18, 20)] == ["…/tables.h", "/…/tables.h", "/opt/…/tables.h", "/…/kernel/tables.h", "/opt/kernel/tables.h"]
    assert [paths.name_cut("mesh.cc", c) for c in range(3, 9)] == ["…/…", "…/…c", "…/m…c", "…/m…cc", "…/me…cc", "…/me….cc"]
    assert column(spark, ["/x/y/z"], "string", lambda c: paths.relative_to(c, F.lit("/x/a"))) == ["../y/z"]
    for cols in range(1, 30):
        assert text.width(paths.shortened_path(["/", "a", "bb", "a_very_long_file_name.cpp"], cols)) <= cols


def test_names():
    assert names.renderings("geo::mesh::cell<signed char>") == ["…::cell<…>", "geo::mesh::cell<…>", "geo::mesh::cell<signed char>"]
    assert names.bounded("a::operator<(b<c>)", 16) == "a::operator<(…)" and names.bounded("x<y>", 2) == "…"
    for n in ("", "((", "a<b", ">>", "f(<)", "operator->*(x)", "(anonymous namespace)::f<int>"):
        assert names.renderings(n)[-1] == n


def test_detail_types(spark):
    cases = {"Expand memcmp() to load/stores": "String", "Live DEBUG_VALUE analysis": "String", "double": "CppEntity", "/test.cpp": "FilePath", "[module]": "Module", "_ZN1a": "Symbol", "(main)": "Symbol", "<unnamed loop>": "UnnamedLoop", "Foo<bar>": "CppEntity", "": None}
    assert column(spark, list(cases), "string", arguments.infer_type) == list(cases.values())


def test_shell_words(spark):
    assert column(spark, ["cc  -c x", "cc 'a b' \"c\\\"d\"", "cc 'open", None], "string", arguments.shell_words) == [["cc", "-c", "x"], ["cc", "a b", 'c"d'], None, None]


def test_units(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"directory":"/b","command":"cc -o x/../y.o -c a.cpp","file":"/a.cpp"},{"directory":"/b","command":"cc","file":"/a.cpp","output":"o/z.o"},{"directory":"/b","command":"cc","file":"/b.cpp","extra":1}]')
    rows = units.read_commands(spark, str(tmp_path / "c.json"))
    assert rows.where("error = 'ParseError'").count() == 1
    parts = build.command_parts(rows.where("error is null").drop("error"))
    assert [r["product"] for r in parts.orderBy("pos").collect()] == ["/b/y.o", "/b/o/z.o"]
    db = units.compilation_database(parts)
    assert [r["trace_file"] for r in db.collect()] == ["/b/o/z.json"]
    with pytest.raises(units.SourceError, match="already"):
        units.push(db, db)
    with pytest.raises(units.SourceError, match="FileNotFound"):
        units.read_commands(spark, str(tmp_path / "none.json"))


def test_profile_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("file,max_rss,time\na,1,0.0\nb,2,NaN\nc,18446744073709551615,+inf\nd,4,-0.1\ne,5,18446744073709551616\nf,6,1.84467e19\ng,7,1.9e19\n")
    got = units.read_profile(spark, str(tmp_path / "p.csv"))
    valid = {r["file"]: r["v"] for r in got.select("file", build.wall_time(F.col("time")).valid.alias("v")).collect()}
    assert valid == {"a": True, "b": False, "c": False, "d": False, "e": True, "f": True, "g": False}
    assert [r["file"] for r in build.unit_table(got, "time").collect()][:3] == ["e", "f", "a"] and build.unit_table(got, "time").collect()[-1]["file"] == "b"
    (tmp_path / "q.csv").write_text("file,max_rss\na,1\n")
    two = units.read_profile(spark, str(tmp_path / "q.csv"))
    assert not build.has_wall_times(two)
    out = str(tmp_path / "out")
    units.write_profile(two.drop("time"), out)
    assert units.read_profile(spark, out).count() == 1
    with pytest.raises(Exception, match="no such profile"):  # a write that fails leaves the old profile, and nothing else
        units.write_profile(two.select("file", F.raise_error(F.lit("no such profile")).cast("long").alias("max_rss")), out)
    assert units.read_profile(spark, out).count() == 1
    units.write_profile(two.drop("time").union(two.drop("time")), out)
    assert units.read_profile(spark, out).count() == 2 and sorted(x.name for x in tmp_path.iterdir() if x.name.startswith("out")) == ["out"]


def test_freshness(spark):
    rows = spark.sql("""select * from values ('none', null, timestamp'2020-01-01', null), ('old', timestamp'2019-01-01', timestamp'2020-01-01', null),
      ('input', timestamp'2020-02-01', timestamp'2020-01-01', timestamp'2020-03-01'), ('equal', timestamp'2020-01-01', timestamp'2020-01-01', timestamp'2020-01-01'), ('future', timestamp'2021-01-01', timestamp'2020-01-01', null)
      as t(k, product_time, database_time, input_time)""").withColumn("now", F.lit("2020-01-02").cast("timestamp"))
    got = {r["k"]: (r["state"], r["age_s"]) for r in build.freshness(rows).collect()}
    assert got == {"none": ("Nonexistent", None), "old": ("Outdated", None), "input": ("Outdated", None), "equal": ("MaybeOutdated", 86400), "future": ("MaybeOutdated", None)}
    assert build.concurrency(None, True, 8) == 1 and build.concurrency(None, False, None) == 4 and build.concurrency(3, True, 8) == 3


def test_adaptive_margin(spark):
    """Against the rule applied tick by tick."""
    rng = random.Random(2)
    rows = [(h, t, rng.choice([0, 10, 10**8, 3 * 10**8, 10**9, 10**9 + rng.randrange(10**9)])) for h in "ab" for t in range(40)]
    got = resources.adaptive_margin(spark.createDataFrame(rows, "host string, tick int, newly_used bigint"), ["host"], "tick", 2).collect()
    for h in "ab":
        margin, want = 3 * resources.MARGIN_PER_JOB, []
        for _, _, used in sorted(r for r in rows if r[0] == h):
            if used > margin:
                margin = (used // 3 + 1) * 3
            want.append(margin)
        assert [r["margin"] for r in sorted(got, key=lambda r: r["tick"]) if r["host"] == h] == want


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.range(2000).selectExpr("concat('j', id % 3) as job", "timestamp_millis(id * 7) as ts", "cast(id % 4 as int) as pid", "id as rss")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = samples.ticks(samples.read_samples(spark, str(tmp_path / "in")))
    samples.write_ticks(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    want = {tuple(r) for r in samples.ticks(ev).collect()}
    got = {tuple(r) for r in done.collect()}
    last = max(r[1] for r in got)
    assert got and got <= want and {r for r in want if r[1] <= last} == got
    assert samples.peaks(done).count() == 3


def test_dictionary(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "v string")
    assert sorted(tuple(r) for r in dictionary.dense_keys(rows, "v").collect()) == [(0, "a"), (1, "b"), (2, "c")]
    d = dictionary.dictionary(rows, "v")
    assert dictionary.collisions(d).count() == 0
    assert sorted(str(r["v"]) for r in dictionary.decode(dictionary.encode(rows, "v", "key"), d, "key").collect()) == ["None", "a", "b", "b", "c"]


def test_job_reports(spark):
    jobs = spark.createDataFrame([(0, 0, None, ""), (1, 0, "a\n", "b\n"), (2, 3, None, None), (3, None, "", "no\n")], "k int, exit_code int, stdout string, stderr string")
    rows = {r["k"]: (r["level"], r["message"]) for r in build.job_reports(jobs).collect()}
    said = "non-empty standard error\n---\n{}---"
    assert rows == {
        0: (None, None), 1: ("warning", "Job had non-empty standard output\n---\na\n---\nand " + said.format("b\n")), 2: ("error", "Job failed with exit status: 3"),
        3: ("error", "Job failed with a signal, it had " + said.format("no\n")),
    }
    runs = spark.createDataFrame([("x", True), ("x", True), ("x", False), ("y", True)], "job string, stopped boolean")
    assert sorted(tuple(r) for r in build.attempts(runs).collect()) == [("x", 3, 2, True), ("y", 1, 1, False)]
    assert build.attempts(runs.limit(0)).count() == 0


def test_public_names():
    import buildlens

    assert all(callable(getattr(buildlens, name)) for name in buildlens.__all__)
    with pytest.raises(AttributeError):
        buildlens.nothing


def test_budgets_as_columns_and_wide_names(spark):
    """Names are measured in terminal columns, with a budget of their own each."""
    names = ["std::map<int, 表表表表>::find(int) const", "ns::very<long<name> >", "漢字::型<a<b> >", "éé<x<y> >", "plain", None]
    rows = [(n, c) for n in names for c in (1, 4, 7, 9, 12, 18, 30, 60)]
    df = spark.createDataFrame(rows, "name string, cols int")
    got = df.select("name", "cols", bounded_entity(entity_renderings(F.col("name")), F.col("cols")).alias("short"), text.shorten(F.col("name"), F.col("cols")).alias("cut"), text.columns_of(F.col("name")).alias("w")).collect()
    for r in got:
        assert r["short"] == (None if r["name"] is None else bounded(r["name"], r["cols"]))
        assert r["name"] is None or text.width(r["short"]) <= r["cols"] and text.width(r["cut"]) <= r["cols"] and r["w"] == text.width(r["name"])


def test_table_functions(spark):
    register_functions(spark)
    rows = spark.createDataFrame([(1, 'cc -c \'a b.cpp\' \\"x\\"'), (2, "open 'quote"), (3, None), (4, "")], "k int, c string")
    got = spark.sql("select k, w.pos, w.word from {rows} r, lateral command_words(text => r.c) w", rows=rows).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "cc"), (1, 1, "-c"), (1, 2, "a b.cpp"), (1, 3, '"x"')]
    levels = spark.sql("select * from entity_levels('ns::a<b<表>>::f')").collect()
    assert [r["rendering"] for r in levels] == names.renderings("ns::a<b<表>>::f") and levels[-1]["width"] == 15
    assert "".join(r["part"] for r in spark.sql("select part from entity_parts('ns::a<b<c>>::f') order by pos").collect()) == "ns::a<b<c>>::f"
    with pytest.raises(Exception, match="a text is needed"):
        spark.sql("select * from command_words(3)").collect()


def test_freshness_of_files(spark, tmp_path):
    def put(name, at):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * 10)
        os.utime(tmp_path / name, (at, at))

    for name, at in (("compile_commands.json", 1000), ("a/old.json", 900), ("a/new.json", 5000), ("a/stale.json", 5000), ("a/future.json", 9000), ("in.cpp", 4000), ("late.h", 6000)):
        put(name, at)
    p = lambda n: str(tmp_path / n)
    rows = [(p("a/old.json"), [p("in.cpp")]), (p("a/new.json"), [p("in.cpp"), p("not there")]), (p("a/stale.json"), [p("in.cpp"), p("late.h")]), (p("a/none.json"), []), (p("a/future.json"), None)]
    files = units.listed_files(spark, str(tmp_path), p("not there"))
    assert files.count() == 7 and files.agg(F.sum("size")).first()[0] == 70
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    got = build.files_freshness(spark.createDataFrame(rows, "product string, inputs array<string>"), files, p("compile_commands.json"), F.timestamp_seconds(F.lit(8000)))
    got = {os.path.basename(r["product"]): (r["state"], r["age_s"]) for r in got.collect()}
    assert got == {"old.json": ("Outdated", None), "new.json": ("MaybeOutdated", 3000), "stale.json": ("Outdated", None), "none.json": ("Nonexistent", None), "future.json": ("MaybeOutdated", None)}
    assert units.listed_files(spark, p("not there")).count() == 0


def test_profile_survives_a_lost_writer(spark, tmp_path):
    """A writer that was lost between its two moves leaves only the old profile, under another name."""
    rows = spark.createDataFrame([("a.cpp", 5, 1.0)], "file string, max_rss bigint, time float")
    path = str(tmp_path / "profile.csv")
    units.write_profile(rows, path)
    os.rename(path, path + ".old")
    with pytest.raises(Exception):
        units.write_profile(rows.withColumn("max_rss", F.raise_error(F.lit("no disk")).cast("bigint")), path)
    assert units.read_profile(spark, path).first()["max_rss"] == 5


def test_sketches_merge(spark):
    """Counts of builds merged from sketches, within four standard errors of the exact ones."""
    rows = [(f"t{k % 6}", "Source" if k % 3 else "InstantiateClass", f"ns{k % 90}::c{k % 4000}<int, t{k % 700}>" if k % 2 else f"/src/d{k % 50}/f{k % 3000}.h") for k in range(30_000)]
    spans = spark.createDataFrame([*rows, ("t0", "Frontend", None), ("t0", "OptModule", "[module]")], "trace_id string, activity string, detail string")
    exact = {r["kind"]: r for r in content.trace_statistics(spans, []).collect()}
    about = {r["kind"]: r for r in content.merged(content.sketches(spans)).collect()}
    assert set(exact) == set(about) == set(content.KINDS)
    for kind, r in exact.items():
        assert about[kind]["n_items"] == r["n_items"]
        assert abs(about[kind]["about_distinct"] - r["n_distinct"]) <= 4 * 1.04 / 2 ** (content.SKETCH / 2) * r["n_distinct"] + 1
    assert exact["activities"]["n_distinct"] == 4 and exact["path_parts"]["longest"] == 3 and exact["scopes"]["n_distinct"] == 45
    assert content.trace_statistics(spans.limit(0)).count() == 0


def test_build_command(spark, tmp_path, capsys):
    from buildlens import cli

    commands = [{"directory": "/b", "command": f"cc -c {n}.cpp", "file": f"/s/{n}.cpp"} for n in "abc"]
    (tmp_path / "db.json").write_text(json.dumps(commands))
    os.utime(tmp_path / "db.json", (1000, 1000))
    path = str(tmp_path / "p.csv")
    args = ["build", "--build-profile", path, "--commands", str(tmp_path / "db.json"), "-g", "100", "-n", "2"]
    assert cli.main(args) == 0 and capsys.readouterr().out == f"{path}: Nonexistent\n"
    units.write_profile(spark.createDataFrame([("/s/a.cpp", 10**9, 2.5), ("/s/b.cpp", 3 * 10**9, 1.0), ("/s/new.cpp", 5, None)], "file string, max_rss bigint, time float"), path)
    assert cli.main(args) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith(path) and "Outdated" not in lines[0] and lines[1].endswith("/s/b.cpp") and lines[2] == "    cc -c b.cpp -ftime-trace -ftime-trace-granularity=100"
    assert lines[3].endswith("/s/a.cpp") and lines[-1] == "… and more units …"
