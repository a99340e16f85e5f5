"""Span forests: nesting, self times, relatives, checks.

Spans of a trace come in the order `pos` of ascending ends.  The parent of a span is the
next later one that starts no later; the subtree of a span is the run of positions from
its first_pos to itself.  Starts and ends on one axis are a sequence of brackets, and running
counts over it, by windows, find both:

* depth: spans that begin before, less those that end before;
* first_pos: the number of spans that lie wholly before;
* parent: the span that begins just before, if it is open; else that of the level's last span
  with one that is.

All windows are on trace_id (and the level), so rows are shuffled to their trace once.
Windows spill; no trace is held whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.operators.shared import checkpoint


def axis(spans: DataFrame) -> DataFrame:
    """Both ends of every span (column __ends: 1 for the end) with __point, their order as a sequence of brackets.

    At one time spans end in the order of pos.  Empty spans stand, the later around the earlier,
    before the next span that ends there, or, behind the last of these, inside what starts there.
    """
    end = F.col("start") + F.col("duration")
    empty = F.col("duration") == 0
    later = Window.partitionBy("trace_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("__end", end)
    full = F.last(F.when(~empty, F.struct("__end", "pos")), ignorenulls=True).over(later)  # the next span that is not empty
    spans = spans.withColumn("__full", full).withColumn("__next", F.when(F.col("__full.__end") == F.col("__end"), F.col("__full.pos"))).drop("__full")

    def point(ends: int, x: str, k: Column, at: Column, step: Column, p: Column) -> Column:
        inner = [x_.cast("bigint").alias(n) for n, x_ in (("k", k), ("at", at), ("step", step), ("p", p))]
        return F.struct(F.lit(ends).alias("ends"), F.struct(F.col(x).cast("double").alias("x"), *inner).alias("point"))

    zero, pos = F.lit(0), F.col("pos")
    slot, at = F.when(F.col("__next").isNull(), 2).otherwise(0), F.coalesce("__next", zero)
    start_point = F.when(empty, point(0, "start", slot, at, zero, -pos)).otherwise(point(0, "start", F.lit(1), zero, zero, -pos))
    end_point = F.when(empty, point(1, "__end", slot, at, F.lit(1), pos)).otherwise(point(1, "__end", zero, pos, F.lit(2), zero))
    both = spans.withColumn("__both", F.explode(F.array(start_point, end_point)))
    return both.withColumn("__point", F.col("__both.point")).withColumn("__ends", F.col("__both.ends")).drop("__both", "__next", "__end")


def nest(spans: DataFrame, sums: bool = False) -> DataFrame:
    """`spans` with end, depth, first_pos, parent_pos, parent_duration, n_descendants; see build_forest for `sums`.

    Needs trace_id, pos (0, 1, ... by ascending end), start, duration.  Roots have a
    null parent_pos.  In a trace whose spans overlap in part the results mean nothing,
    but some span then has a parent_pos below its pos: see forest_errors.  A trace is sorted
    in one task: see brackets.nest_in_chunks for larger ones.
    """
    trace = Window.partitionBy("trace_id").orderBy("__point")
    running = trace.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.col("__ends") == 0
    points = axis(spans)
    points = points.select("trace_id", "__point", "__ends", *[F.when(starts, F.col(c)).alias(c) for c in spans.columns if c != "trace_id"])  # an end is a bare bracket
    # the span that begins just before another, and is open, is its parent
    me = F.struct(F.col("pos").cast("int").alias("pos"), F.col("duration").cast("double").alias("duration"))
    points = points.select("*", F.sum("__ends").over(running).alias("__ended"), F.count("*").over(running).alias("__passed"), F.lag(F.when(starts, me)).over(trace).alias("__above")).where(starts)
    points = points.withColumn("end", F.col("start") + F.col("duration")).withColumn("first_pos", F.col("__ended").cast("int"))
    points = points.withColumn("depth", (F.col("__passed") - 1 - 2 * F.col("__ended")).cast("int")).drop("__ends", "__ended", "__passed")
    # one that follows the end of another has the parent of the last first child of its level
    level = Window.partitionBy("trace_id", "depth").orderBy("__point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = points.withColumn("__up", F.last("__above", ignorenulls=True).over(level))
    out = out.withColumn("parent_pos", F.col("__up.pos")).withColumn("parent_duration", F.col("__up.duration")).drop("__point", "__up", "__above")
    if sums:
        # a span stands with its children: every child is there twice, once bare
        role = lambda child, at: F.struct(F.lit(child).alias("child"), at.cast("bigint").alias("of"))
        roles = out.withColumn("__role", F.explode(F.array(role(False, F.col("pos")), role(True, F.col("parent_pos"))))).where("__role.of is not null")
        child = F.col("__role.child")
        roles = roles.select("trace_id", F.col("__role.of").alias("__of"), child.alias("__child"), F.when(child, F.col("duration")).alias("__inner"), *[F.when(~child, F.col(c)).alias(c) for c in out.columns if c != "trace_id"])
        family = Window.partitionBy("trace_id", "__of")
        roles = roles.select("*", F.sum(F.col("__child").cast("int")).over(family).cast("int").alias("n_children"), F.sum("__inner").over(family).alias("__busy")).where("not __child")
        out = roles.withColumn("self_duration", F.col("duration") - F.coalesce("__busy", F.lit(0.0))).drop("__of", "__child", "__inner", "__busy")
    return out.withColumn("n_descendants", F.col("pos") - F.col("first_pos"))


def build_forest(spans: DataFrame) -> DataFrame:
    """`nest` with n_children and self_duration, the duration less that of the direct children, in the same pass."""
    return nest(spans, sums=True)


def order_errors(spans: DataFrame) -> DataFrame:
    """(trace_id, pos, end, previous_end) of spans that end before the one in front of them."""
    w = Window.partitionBy("trace_id").orderBy("pos")
    ends = spans.select("trace_id", "pos", (F.col("start") + F.col("duration")).alias("end"))
    return ends.withColumn("previous_end", F.lag("end").over(w)).where("end < previous_end")


def overlapping_traces(nested: DataFrame) -> DataFrame:
    """trace_id of the traces, in order, in which some span begins inside an earlier one and ends with it or later.

    If every span's parent has a later position, open spans always form a chain of
    parents, so that no two overlap in part; the converse holds by definition.
    """
    return nested.where("parent_pos < pos").select("trace_id").distinct()


def overlaps(spans: DataFrame) -> DataFrame:
    """(trace_id, pos, earlier_pos) for every span that begins inside earlier ones: the last of them.

    Times are ranked within a trace; beginnings are points, the ranks between beginning and
    end a range, so that beginnings meet only the spans round them.
    """
    end = F.col("start") + F.col("duration")
    moments = spans.select("trace_id", "pos", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(True).alias("begins")), F.struct(end.alias("t"), F.lit(False).alias("begins")))).alias("m"))
    ranked = moments.select("trace_id", "pos", "m.begins", F.dense_rank().over(Window.partitionBy("trace_id").orderBy("m.t")).cast("bigint").alias("rank"))
    points = ranked.where("begins").select("trace_id", "pos", F.col("rank").alias("point"))
    rank_of = lambda begins: F.max(F.when(F.col("begins") == begins, F.col("rank")))
    ranges = ranked.groupBy("trace_id", F.col("pos").alias("earlier_pos")).agg((rank_of(True) + 1).alias("begin"), rank_of(False).alias("end"))
    return _inside(ranges, points).where("earlier_pos < pos").groupBy("trace_id", "pos").agg(F.max("earlier_pos").alias("earlier_pos"))


def roots(forest: DataFrame) -> DataFrame:
    return forest.where("parent_pos is null")


def span_at(forest: DataFrame, pos: int) -> DataFrame:
    return forest.where(F.col("pos") == pos)


def _with_parent(forest: DataFrame, value: Column) -> DataFrame:
    """`forest` with __parent, the value (a null counts as none) of each span's parent.

    A span stands with its children, once bare, in a window on the trace: no join, and the rows stay in
    the partitions of their traces, however many these are.
    """
    role = lambda child, at, x: F.struct(F.lit(child).alias("child"), at.cast("bigint").alias("of"), x.alias("value"))
    roles = forest.withColumn("__role", F.explode(F.array(role(False, F.col("pos"), value), role(True, F.col("parent_pos"), F.when(F.lit(False), value)))))
    roles = roles.where("__role.child or __role.value is not null")
    child = F.col("__role.child")
    roles = roles.select("trace_id", "__role", *[F.when(child, F.col(c)).alias(c) for c in forest.columns if c != "trace_id"])
    up = F.max("__role.value").over(Window.partitionBy("trace_id", "__role.of"))
    return roles.withColumn("__parent", up).where("__role.child").select(*forest.columns, "__parent")


def parents(forest: DataFrame, *columns: str) -> DataFrame:
    """`forest` with the given columns of each span's parent, as parent_<column>."""
    rows = _with_parent(forest.drop(*[f"parent_{c}" for c in columns]), F.struct(*columns))
    return rows.select("*", *[F.col("__parent").getField(c).alias(f"parent_{c}") for c in columns]).drop("__parent")


def children(forest: DataFrame, of: DataFrame | Column) -> DataFrame:
    """Direct children of the spans `of`: those that meet a condition, or a frame of trace_id and pos, which takes a join."""
    if isinstance(of, DataFrame):
        return forest.join(of.select("trace_id", F.col("pos").alias("parent_pos")).distinct(), ["trace_id", "parent_pos"])
    return _with_parent(forest, F.when(of, F.lit(True))).where("__parent").drop("__parent")


_FAN = 16  # blocks of positions: 1, 16, 256 ... long
_TIERS = 8  # of 16 ** 8 = 2 ** 32 positions at most


def _inside(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """Every point (trace_id, point) with every range (trace_id, begin, end) that holds it: an equi-join as large as its result.

    A range is cut into the fewest aligned blocks, a point lies in one block of every
    size, and so they meet in one block or in none.
    """
    at = lambda k: F.pow(F.lit(_FAN), k).cast("bigint")
    cut = ranges.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(_TIERS - 1))))
    lo, hi = (lambda k: F.ceil(F.col("begin") / at(k))), (lambda k: F.floor(F.col("end") / at(k)))
    k = F.col("__k")
    cut = cut.withColumn("__l", lo(k)).withColumn("__r", hi(k)).withColumn("__l2", lo(k + 1) * _FAN).withColumn("__r2", hi(k + 1) * _FAN).where("__l < __r")
    run = lambda a, b: F.when(F.col(a) < F.col(b), F.sequence(F.col(a), F.col(b) - 1)).otherwise(F.array().cast("array<bigint>"))
    blocks = F.when(F.col("__l2") < F.col("__r2"), F.concat(run("__l", "__l2"), run("__r2", "__r"))).otherwise(run("__l", "__r"))
    cut = cut.withColumn("__block", F.explode(blocks)).drop("__l", "__r", "__l2", "__r2")
    points = points.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(_TIERS - 1)))).withColumn("__block", F.floor(F.col("point") / at(k)))
    return cut.join(points, ["trace_id", "__k", "__block"]).drop("__k", "__block")


def descendants(forest: DataFrame, of: DataFrame) -> DataFrame:
    """All spans below each of `of` (trace_id, pos, first_pos), with ancestor_pos: a run of positions, no recursion."""
    top = of.select("trace_id", F.col("pos").alias("ancestor_pos"), F.col("first_pos").alias("begin"), F.col("pos").alias("end"))
    held = forest.select(F.struct("*").alias("__span"), "trace_id", F.col("pos").alias("point"))
    return _inside(top, held).select("__span.*", "ancestor_pos")


def ancestors(forest: DataFrame, of: DataFrame) -> DataFrame:
    """All spans above each of `of` (trace_id, pos), with below_pos: the innermost has the least pos."""
    low = of.select("trace_id", F.col("pos").alias("below_pos"), F.col("pos").alias("point"))
    held = forest.select(F.struct("*").alias("__span"), "trace_id", F.col("first_pos").alias("begin"), F.col("pos").alias("end"))
    return _inside(held, low).select("__span.*", "below_pos")


def with_children(forest: DataFrame) -> DataFrame:
    """Spans that have a direct child: their subtree begins before them."""
    return forest.where("first_pos < pos")


def leaves(forest: DataFrame) -> DataFrame:
    return forest.where("first_pos = pos")


def zoom(forest: DataFrame, pos: int, flat: bool = False) -> DataFrame:
    """What lies below one span of each trace, with percent of that span: direct children, or all spans below."""
    top = F.max(F.when(F.col("pos") == pos, F.struct("pos", "first_pos", "duration"))).over(Window.partitionBy("trace_id"))
    rows = forest.withColumn("__top", top)
    inside: Column = F.col("pos").between(F.col("__top.first_pos"), F.col("__top.pos") - 1) if flat else F.col("parent_pos") == F.col("__top.pos")
    return rows.where(inside).withColumn("percent", F.try_divide(F.col("duration") * 100, F.col("__top.duration"))).drop("__top")


def process_trees(processes: DataFrame, root_pids: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys (by default job) and pid of every process below, or being, a root of the same keys.

    `processes`: keys, pid, ppid; `root_pids`: keys, pid.  With a tick among the keys there is a tree a
    tick.  A level a round: children of the last level that are not found yet, so trees of any depth
    end, and cycles too.  Only new levels are written.
    """
    keys = keys or ["job"]
    links = checkpoint(processes.select(*keys, "pid", "ppid").where("pid <> ppid").distinct())
    levels = [checkpoint(root_pids.select(*keys, "pid").distinct())]
    while True:
        below = links.join(levels[-1].withColumnRenamed("pid", "ppid"), [*keys, "ppid"]).select(*keys, "pid").distinct()
        found = reduce(DataFrame.union, levels)
        levels.append(checkpoint(below.join(found, [*keys, "pid"], "left_anti")))
        if levels[-1].isEmpty():
            return found
