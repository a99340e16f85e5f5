"""python -m buildlens.cli report TRACE.json | build [--build-profile CSV] [-g US] | shorten -c N [NAME]"""

from __future__ import annotations

import argparse
import sys


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="buildlens")
    commands = parser.add_subparsers(dest="command", required=True)
    r = commands.add_parser("report", help="profile of one time trace")
    r.add_argument("input")
    r.add_argument("-s", "--self-threshold", type=float, default=0.5, help="percent")
    r.add_argument("-i", "--hierarchical-threshold", type=float, default=0.5, help="percent")
    r.add_argument("-c", "--cols", type=int, default=200)
    r.add_argument("--by-ranges", action="store_true", help="read by byte ranges: for traces that fit no task")
    b = commands.add_parser("build", help="units of a whole build, by memory or time")
    b.add_argument("--build-profile", default="cmakeperf.csv")
    b.add_argument("--commands", default="compile_commands.json", help="compilation database")
    b.add_argument("--sort", choices=["max_rss", "time", "file"], default="max_rss")
    b.add_argument("-n", "--lines", type=int, default=50, help="units shown")
    b.add_argument("-g", "--granularity", type=int, help="of the time trace that a unit's command writes, in microseconds")
    s = commands.add_parser("shorten", help="a C++ entity name in few columns")
    s.add_argument("-c", "--cols", type=int, required=True)
    s.add_argument("entity", nargs="?")
    return parser


def build_text(spark, profile: str, commands: str, sort: str, lines: int, granularity: int | None) -> str:
    """The first units of a build profile with memory, time and the command that writes their trace, and how fresh the profile is."""
    from pyspark.sql import functions as F

    from buildlens.operators import build
    from buildlens.sources import units

    files = units.listed_files(spark, profile, commands)
    state = build.files_freshness(spark.createDataFrame([(profile, [])], "product string, inputs array<string>"), files, commands, F.current_timestamp())
    fresh = state.select(build.freshness_text(F.col("state"), F.col("age_s"))).first()[0]
    out = [f"{profile}: {fresh}"]
    if fresh == "Nonexistent":
        return "\n".join(out) + "\n"
    known = units.compilation_database(units.read_commands(spark, commands)).select("file", build.trace_command(F.col("command"), granularity).alias("trace_command"))
    table = build.unit_table(units.read_profile(spark, profile), sort).limit(lines + 1).collect()
    asked = spark.createDataFrame([(r["file"],) for r in table[:lines]], "file string")
    command = {r["file"]: r["trace_command"] for r in known.join(F.broadcast(asked), "file", "left_semi").collect()}
    for r in table[:lines]:
        out.append("  ".join(filter(None, [r["rss_text"], r["time_text"], r["file"]])))
        if r["file"] in command:
            out.append(f"    {command[r['file']]}")
    if len(table) > lines:
        out.append("… and more units …")
    return "\n".join(out) + "\n"


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "shorten":
        from buildlens.functions.names import bounded

        print(bounded((args.entity if args.entity is not None else sys.stdin.read()).strip(), args.cols))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("buildlens").getOrCreate()
    if args.command == "build":
        print(build_text(spark, args.build_profile, args.commands, args.sort, args.lines, args.granularity), end="")
        return 0
    from buildlens.plans.report import report
    from buildlens.plans.trace import Traces

    read = Traces.read_ranges if args.by_ranges else Traces.read
    print(report(read(spark, args.input), args.self_threshold, args.hierarchical_threshold, args.cols), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
