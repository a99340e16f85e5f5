"""A text report on one trace: metadata, activity types, flat and hierarchical profile."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from buildlens.functions.text import ELLIPSIS, duration_text, profile_text, width
from buildlens.operators import profile as profiles
from buildlens.plans.trace import Traces, described


def recorded(us: float) -> str:
    """RFC 3339 text of microseconds since 1970; no fraction if there is none."""
    t = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=int(us))
    frac = f".{t.microsecond:06d}".rstrip("0") if t.microsecond else ""
    return t.strftime("%Y-%m-%dT%H:%M:%S") + frac + "Z"


def metadata_text(process: str, pid: int | None, thread: str | None, epoch: float | None, cols: int) -> str:
    """`Data from <process>, pid <n>, thread "<t>", recorded <time>.`, wrapped; what fits no line is an ellipsis."""
    room = cols - 1  # for the comma or full stop behind each part
    first = f"Data from {process}"
    if width(first) > room:
        return ELLIPSIS
    parts = [f"pid {pid}"] * (pid is not None) + [f'thread "{thread}"'] * (thread is not None) + [f"recorded {recorded(epoch)}"] * (epoch is not None)
    lines = [first]
    for part in parts:
        text = part if width(part) <= room else ELLIPSIS
        if width(lines[-1]) + 2 + width(text) <= room:
            lines[-1] += f", {text}"
        else:
            lines[-1] += ","
            lines.append(text)
    return "\n".join(lines) + "."


def report(traces: Traces, self_threshold: float = 0.5, hierarchical_threshold: float = 0.5, cols: int = 200) -> str:
    """The report as text; thresholds are percentages.

    Rows above a threshold reach the driver, a partition at a time: at most 100 / threshold of each
    list and level.  Each list ends with how many it leaves out.
    """
    meta = traces.loaded.traces.limit(2).collect()
    if len(meta) != 1:
        raise ValueError("a report is about one trace")
    m = meta[0]
    out = [metadata_text(m["process_name"], m["pid"], m["thread_name"], m["beginning_of_time"], cols), ""]
    spans = traces.spans
    flat_t, tree_t = self_threshold / 100, hierarchical_threshold / 100
    types = traces.breakdown().withColumn("shown", F.col("share") >= flat_t)
    rows = types.where("shown").withColumn("t", profile_text(F.col("self_duration"), F.col("share"))).orderBy(F.desc("self_duration"), "activity").toLocalIterator()
    others = types.where("not shown").count()
    out += ["Self-duration breakdown by activity type:"] + [f"- {r['activity']}{r['t']}" for r in rows] + [f"- … and {others} other activity types …"] * (others > 0) + [""]
    flat = profiles.with_share(spans, "self_duration").withColumn("shown", F.col("share") >= flat_t)
    rows = described(flat.where("shown").withColumn("t", profile_text(F.col("self_duration"), F.col("share"))), cols - 24).orderBy(F.desc("self_duration"), "pos").toLocalIterator()
    others = flat.where("not shown").count()
    out += ["Hot activities by self-duration:"] + [f"- {r['description'] or ELLIPSIS}{r['t']}" for r in rows] + [f"- … and {others} other activities …"] * (others > 0) + [""]
    tree = described(profiles.report_tree(spans, tree_t).withColumn("t", profile_text(F.col("duration"), F.col("share"))), cols - 24).orderBy("trace_id", "place")
    out.append("Tree of hot activities:")
    for r in tree.toLocalIterator():
        what = f"{r['description'] or ELLIPSIS}{r['t']}" if not r["n_hidden"] else f"… and {r['n_hidden']} other {'children' if r['depth'] else 'activities'} …"
        out.append(f"{'  ' * r['depth']}- {what}")
    return "\n".join(out) + "\n"


def total_text(traces: Traces) -> str:
    return traces.roots().agg(F.sum("duration").alias("d")).select(duration_text(F.col("d"))).first()[0]
