"""Profiles of span forests: norms, breakdowns, hottest spans, percentages, remainders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duration_norm(forest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total (duration of the roots) and norm, its inverse, over everything or for each key of `by`."""
    total = F.sum("duration").alias("total")
    roots = forest.where("parent_pos is null")
    out = roots.groupBy(*by).agg(total) if by else roots.agg(total)
    return out.withColumn("norm", F.try_divide(F.lit(1.0), "total"))


def percent_norm(total: Column) -> Column:
    """100 / total; null where total is zero or not finite."""
    return F.when((total != 0) & ~F.isnan(total) & (F.abs(total) < float("inf")), F.lit(100.0) / total)


def _roots_total(by: list[str]) -> Column:
    """Duration of the roots of each key, beside every row."""
    return F.sum(F.when(F.col("parent_pos").isNull(), F.col("duration"))).over(Window.partitionBy(*by))


def with_share(forest: DataFrame, metric: str | Column = "duration", by: list[str] | None = None) -> DataFrame:
    """`forest` with share: the metric over the total of the roots, of each key of `by` or of everything (one row, broadcast)."""
    value = F.col(metric) if isinstance(metric, str) else metric
    if by:
        return forest.withColumn("share", value * F.try_divide(F.lit(1.0), _roots_total(by)))
    joined = forest.crossJoin(F.broadcast(duration_norm(forest).drop("total")))  # a single row
    return joined.withColumn("share", value * F.col("norm")).drop("norm")


def activity_breakdown(forest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """activity, self_duration (summed), n_spans, share of all self time; sort by self_duration, descending.

    The sums are made map-side; what is shuffled has a row an activity and task.  The
    total of the roots is summed with them, so the forest is built once.
    """
    keys = [*(by or []), "activity"]
    roots = F.sum(F.when(F.col("parent_pos").isNull(), F.col("duration"))).alias("__roots")
    sums = forest.groupBy(*keys).agg(F.sum("self_duration").alias("self_duration"), F.count("*").alias("n_spans"), roots)
    total = F.sum("__roots").over(Window.partitionBy(*(by or [F.lit(0)])))  # over a row an activity
    return sums.withColumn("share", F.col("self_duration") * F.try_divide(F.lit(1.0), total)).drop("__roots")


def hottest(spans: DataFrame, metric: str | Column, threshold: float) -> DataFrame:
    """Spans with metric >= threshold, hottest first; ties by trace and position."""
    value = F.col(metric) if isinstance(metric, str) else metric
    return spans.where(value >= threshold).orderBy(value.desc(), "trace_id", "pos")


def flat_profile(forest: DataFrame, threshold: float = 0.005, by: list[str] | None = None) -> DataFrame:
    """Spans whose own time is at least `threshold` of the total, with that share."""
    return with_share(forest, "self_duration", by).where(F.col("share") >= threshold)


def hierarchical_profile(forest: DataFrame, threshold: float = 0.005, by: list[str] | None = None) -> DataFrame:
    """Spans that last at least `threshold` of the total, with the share.

    A span never outlasts its parent, so the ancestors of what is kept are kept too and
    one filter prunes whole subtrees.
    """
    return with_share(forest, "duration", by).where(F.col("share") >= threshold)


def tree_order(profile: DataFrame) -> DataFrame:
    """`profile` with place: 0, 1, ... in each trace, parents before children, siblings from long to short.

    Needs trace_id, pos, first_pos, parent_pos, duration; every parent of a row must be a row.  A
    row stands behind its parent and the subtrees of the siblings before it, so its place is a sum
    over its ancestors and itself.  These are the intervals of positions round it: what each adds
    goes in where it begins and out where it ends, and one running sum over the positions gives all
    places, however deep the tree.
    """
    return _in_order(profile.withColumn("__at", 2 * F.col("pos").cast("bigint")).withColumn("__from", 2 * F.col("first_pos").cast("bigint") - 1)).drop("__at", "__from")


def _in_order(rows: DataFrame) -> DataFrame:
    """Places of rows that are intervals from __from to __at of their trace."""
    trace = Window.partitionBy("trace_id")
    upto = Window.unboundedPreceding, Window.currentRow
    edge = lambda at, into: F.struct(F.col(at).alias("at"), F.lit(into).alias("into"))  # noqa: E731  an interval is entered before its own row, left behind it
    edges = rows.withColumn("__edge", F.explode(F.array(edge("__from", 0), edge("__at", 1))))
    line = trace.orderBy("__edge.at", "__edge.into").rangeBetween(*upto)
    own = Window.partitionBy("trace_id", "__at").orderBy("__edge.into")
    # rows up to here, less those before the begin: the size of the subtree
    edges = edges.withColumn("__rows", F.sum("__edge.into").over(line))
    edges = edges.withColumn("__size", F.col("__rows") - F.lag("__rows").over(own)).where("__edge.into = 1").drop("__edge", "__rows")
    elder = Window.partitionBy("trace_id", "parent_pos").orderBy(F.col("pos").isNull(), F.desc("duration"), "pos").rowsBetween(Window.unboundedPreceding, -1)
    step = F.coalesce(F.sum("__size").over(elder), F.lit(0)) + F.col("parent_pos").isNotNull().cast("int")
    edges = edges.withColumn("__step", step)
    come = F.struct(F.col("__from").alias("at"), F.lit(0).alias("into"), F.col("__step").alias("by"))
    go = F.struct((F.col("__at") + 1).alias("at"), F.lit(-1).alias("into"), (-F.col("__step")).alias("by"))
    here = F.struct(F.col("__at").alias("at"), F.lit(1).alias("into"), F.lit(0).cast("bigint").alias("by"))
    sums = edges.withColumn("__edge", F.explode(F.array(come, go, here))).withColumn("place", F.sum("__edge.by").over(trace.orderBy("__edge.at", "__edge.into").rangeBetween(*upto)))
    return sums.where("__edge.into = 1").drop("__edge", "__size", "__step")


def report_tree(forest: DataFrame, threshold: float = 0.005, by: list[str] | None = None) -> DataFrame:
    """The hierarchical profile in the order of a report, with a line for what it leaves out.

    Rows of `hierarchical_profile` with n_hidden 0, and behind the children of each the line of its
    hidden children: their number n_hidden and summed duration, null pos, one level deeper.  Hidden
    roots have a line at the end.  Columns: trace_id, place, depth, pos, parent_pos, activity,
    duration, share, n_hidden, and detail where the forest has it.
    """
    detail = [c for c in ("detail", "arg_type") if c in forest.columns]
    # a parent is shown if its own share is large enough, which its duration tells without a join
    rows = with_share(forest, F.lit(1.0), by).withColumnRenamed("share", "__norm")
    rows = rows.withColumn("share", F.col("duration") * F.col("__norm")).withColumn("__up", F.col("parent_duration") * F.col("__norm"))
    rows = rows.withColumn("__seen", F.coalesce(F.col("share") >= threshold, F.lit(False)))
    hidden = Window.partitionBy("trace_id", "parent_pos", "__seen")
    whole = lambda x: F.when(F.col("__seen"), F.col(x)).otherwise(F.sum(x).over(hidden))
    rows = rows.select(
        "trace_id", "pos", "first_pos", "parent_pos", "activity", *detail, "__seen", "__up",
        F.min("depth").over(hidden).alias("depth"), whole("duration").alias("duration"), whole("share").alias("share"),
        F.when(F.col("__seen"), 0).otherwise(F.count("*").over(hidden)).cast("bigint").alias("n_hidden"), F.row_number().over(hidden.orderBy("pos")).alias("__nth"),
    )
    # one line for the hidden children of a shown parent, and one for hidden roots
    rows = rows.where(F.col("__seen") | ((F.col("__nth") == 1) & (F.col("parent_pos").isNull() | F.coalesce(F.col("__up") >= threshold, F.lit(False)))))
    behind = F.when(F.col("parent_pos").isNull(), F.lit(2**62)).otherwise(2 * F.col("parent_pos").cast("bigint") - 1)  # behind all children, or all of the trace
    at = F.when(F.col("__seen"), 2 * F.col("pos").cast("bigint")).otherwise(behind)
    begin = F.when(F.col("__seen"), 2 * F.col("first_pos").cast("bigint") - 1).otherwise(behind)
    known = lambda c, kind: F.when(F.col("__seen"), F.col(c)).cast(kind).alias(c)  # noqa: E731  lines have no position or text
    rows = rows.select("trace_id", known("pos", "bigint"), "parent_pos", "depth", *[known(c, "string") for c in ("activity", *detail)], "duration", "share", "n_hidden", at.alias("__at"), begin.alias("__from"))
    return _in_order(rows).drop("__at", "__from")


def remainder(spans: DataFrame, metric: str | Column, threshold: float, by: list[str] | None = None) -> DataFrame:
    """n_shown and n_other: how many rows reach the threshold and how many do not."""
    value = F.col(metric) if isinstance(metric, str) else metric
    shown = F.count(F.when(value >= threshold, 1)).alias("n_shown")
    other = F.count(F.when(~F.coalesce(value >= threshold, F.lit(False)), 1)).alias("n_other")
    return spans.groupBy(*by).agg(shown, other) if by else spans.agg(shown, other)


def percent_of_parent(forest: DataFrame) -> DataFrame:
    """`forest` with percent of the parent's duration; of a root: of all roots of its trace."""
    norm = F.coalesce("parent_duration", _roots_total(["trace_id"]))
    return forest.withColumn("percent", F.try_divide(F.col("duration") * 100, norm))


def percent_of_total(forest: DataFrame) -> DataFrame:
    """`forest` with percent of its trace's total."""
    return with_share(forest, "duration", ["trace_id"]).withColumn("percent", F.col("share") * 100).drop("share")


UNITS = ("global", "parent", "time")


def next_unit(unit: str) -> str:
    return UNITS[(UNITS.index(unit) + 1) % len(UNITS)]


def with_factor(forest: DataFrame, unit: str) -> tuple[DataFrame, Column]:
    """`forest`, with percent where the unit needs it, and what turns its durations into the unit."""
    if unit == "time":
        return forest, F.lit(1.0)
    return (percent_of_parent if unit == "parent" else percent_of_total)(forest), F.try_divide("percent", "duration")


def unit_totals(forest: DataFrame, units: list[str]) -> DataFrame:
    """step, unit, n and total: rows and summed totals of the hierarchical profile in each of `units`, in one pass."""
    sums = []
    for unit in dict.fromkeys(units):
        forest, factor = with_factor(forest.drop("percent"), unit)
        forest = forest.withColumn(f"__{unit}", F.col("duration") * factor)
        shown = F.when(F.col(f"__{unit}") >= 0.0, F.col(f"__{unit}"))
        sums.append(F.struct(F.count(shown).alias("n"), F.sum(shown).alias("total")).alias(unit))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(u).alias("unit"), F.col(f"{u}.n").alias("n"), F.col(f"{u}.total").alias("total")) for i, u in enumerate(units)]
    return forest.agg(*sums).select(F.inline(F.array(*rows)))


def profile(forest: DataFrame, mode: str = "hierarchical", unit: str = "global", threshold: float = 0.0, sort: str = "total", descending: bool = True) -> DataFrame:
    """A table of spans: mode flat or hierarchical, unit global, parent or time, sorted by total, self or description.

    Columns: trace_id, pos, description (with + before spans that have children, in
    hierarchical mode), total, self.  total and self are percentages or microseconds.
    """
    if mode not in ("flat", "hierarchical") or unit not in UNITS or sort not in ("total", "self", "description"):
        raise ValueError(f"unknown mode, unit or sort: {mode}, {unit}, {sort}")
    rows, factor = with_factor(forest, unit)
    name = F.concat_ws(": ", "activity", "detail") if "detail" in forest.columns else F.col("activity")
    mark = F.when(F.col("n_children") > 0, "+").otherwise(" ")
    rows = rows.select("trace_id", "pos", (F.concat(mark, name) if mode == "hierarchical" else name).alias("description"), (F.col("duration") * factor).alias("total"), (F.col("self_duration") * factor).alias("self"))
    key = "self" if mode == "flat" and sort == "total" else sort
    rows = rows.where(F.col("self" if mode == "flat" else "total") >= threshold)
    return rows.orderBy(F.col(key).desc() if descending else F.col(key).asc(), "trace_id", "pos")


def global_average(stats: DataFrame) -> DataFrame:
    """`stats` with average_duration; null where count is 0."""
    return stats.withColumn("average_duration", F.try_divide("total_duration", F.col("count")))


def level_totals(forest: DataFrame) -> DataFrame:
    """Spans and time by depth: depth, n_spans, duration, self_duration."""
    return forest.groupBy("depth").agg(F.count("*").alias("n_spans"), F.sum("duration").alias("duration"), F.sum("self_duration").alias("self_duration"))


def by_metric_rank(spans: DataFrame, metric: str, by: list[str], top: int) -> DataFrame:
    """The `top` spans of each group by a metric; Spark prunes each task to its own top rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(metric), "trace_id", "pos")
    return spans.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
