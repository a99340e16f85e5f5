"""A whole build: commands, products and their freshness, unit profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.arguments import shell_words
from buildlens.functions.paths import normalized
from buildlens.functions.text import age_text, memory_text, seconds_text

#: Above this, a wall time is no number of seconds.
TOO_LONG = float(2**64)


def command_parts(commands: DataFrame) -> DataFrame:
    """`commands` with words, program, args, product and trace_file.

    product is the given output or what follows the first -o, in the entry's folder;
    trace_file is where the compiler puts the trace of that product.
    """
    words = commands.withColumn("words", shell_words(F.col("command")))
    at = F.array_position("words", F.lit("-o"))
    named = F.when(at > 0, F.try_element_at("words", (at + 1).cast("int")))
    given = F.coalesce("output", named)
    product = F.when(given.startswith("/"), given).otherwise(F.concat(F.col("directory"), F.lit("/"), given))
    out = words.withColumn("program", F.try_element_at("words", F.lit(1))).withColumn("args", F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))))
    out = out.withColumn("product", F.coalesce(normalized(product), product))
    return out.withColumn("trace_file", F.concat(F.regexp_replace("product", r"\.[^./]*$", ""), F.lit(".json")))


def wall_time(time: Column) -> Column:
    """(valid, value): whether a number is a time in seconds at all; null stays null."""
    valid = ~(F.isnan(time) | (time < 0) | (time > TOO_LONG))
    return F.when(time.isNotNull(), F.struct(valid.alias("valid"), time.alias("value")))


def has_wall_times(profiles: DataFrame) -> bool:
    return profiles.where("time is not null").limit(1).count() > 0


def unit_table(profiles: DataFrame, sort: str = "max_rss") -> DataFrame:
    """Units with rss_text and time_text, sorted by max_rss or time, descending, or by file.

    By time, valid ones come before invalid ones, NaN last of all.
    """
    t = wall_time(F.col("time"))
    rows = profiles.withColumn("time_valid", t.valid).withColumn("rss_text", memory_text(F.col("max_rss"))).withColumn("time_text", F.when(t.valid, seconds_text(F.col("time"))).when(t.isNotNull(), "invalid"))
    order = {"max_rss": [F.desc("max_rss"), F.asc("file")], "time": [F.desc("time_valid"), F.asc(F.isnan("time")), F.desc("time"), F.asc("file")], "file": [F.asc("file")]}
    return rows.orderBy(*order[sort])


def freshness(products: DataFrame) -> DataFrame:
    """`products` with state and age_s.

    Needs product_time (null: no such file), database_time, input_time (the latest of
    the inputs), now.  A product is outdated if strictly older than database or inputs;
    an age is null where the product lies in the future.
    """
    t = F.col("product_time")
    state = F.when(t.isNull(), "Nonexistent").when((t < F.col("database_time")) | F.coalesce(t < F.col("input_time"), F.lit(False)), "Outdated").otherwise("MaybeOutdated")
    age = F.when((state == "MaybeOutdated") & (t <= F.col("now")), F.unix_timestamp("now") - F.unix_timestamp("product_time"))
    return products.withColumn("state", state).withColumn("age_s", age)


def file_name(path: Column) -> Column:
    """A path without its scheme, as listings and databases both have it."""
    return F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:/*(?=/)", "")


def files_freshness(products: DataFrame, files: DataFrame, database: str, now: Column) -> DataFrame:
    """`freshness` from a listing: `products` (product, inputs array) with product_time, database_time, input_time, state, age_s.

    `files`: path, modified (see sources.units.listed_files).  A folder is as new as the newest file in
    it, as products of several parts are folders.  Inputs that are not listed are older
    than anything; without a database file every product is outdated that exists.
    """
    name = file_name(F.col("path"))
    both = F.array(name, F.regexp_replace(name, "/[^/]*$", ""))
    times = files.select(F.explode(both).alias("__path"), "modified").groupBy("__path").agg(F.max("modified").alias("__time"))
    rows = products.withColumn("__row", F.monotonically_increasing_id())
    inputs = rows.select("__row", F.explode("inputs").alias("__in"))
    latest = inputs.join(times, file_name(F.col("__in")) == F.col("__path")).groupBy("__row").agg(F.max("__time").alias("input_time"))
    own = times.withColumnRenamed("__time", "product_time")
    base = times.where(F.col("__path") == file_name(F.lit(database))).agg(F.coalesce(F.max("__time"), F.lit("9999-01-01").cast("timestamp")).alias("database_time"))
    rows = rows.join(own, file_name(F.col("product")) == F.col("__path"), "left").drop("__path").join(latest, "__row", "left").drop("__row")
    return freshness(rows.crossJoin(F.broadcast(base)).withColumn("now", now))  # a single row


def should_measure(state: Column, age_s: Column, user_given: Column) -> Column:
    """Whether to offer a new measurement: always if missing or outdated, else if a minute old and not named by the user."""
    return state.isin("Nonexistent", "Outdated") | ((state == "MaybeOutdated") & ~user_given & (F.coalesce(age_s, F.lit(60)) >= 60))


def freshness_text(state: Column, age_s: Column) -> Column:
    return F.when(state == "MaybeOutdated", F.coalesce(age_text(age_s), F.lit("in the future"))).otherwise(state)


def units_with_commands(profiles: DataFrame, commands: DataFrame) -> DataFrame:
    """Unit profiles with their commands' columns, by file; units without a command keep nulls."""
    return profiles.join(command_parts(commands), "file", "left")


def concurrency(explicit: int | None, timed: bool, cpus: int | None) -> int:
    """Jobs at once: as asked, else one when times are measured, else one a CPU (4 if unknown)."""
    return explicit or (1 if timed else cpus or 4)


def trace_command(command: Column, granularity: int | None = None) -> Column:
    """The command that also writes a time trace."""
    extra = " -ftime-trace" + (f" -ftime-trace-granularity={granularity}" if granularity is not None else "")
    return F.concat(command, F.lit(extra))


def compiler_version(text: Column) -> Column:
    """(major, minor, error) from what a compiler says of itself: EmptyVersion, UnexpectedVersion, or AncientVersion below 9."""
    line = F.element_at(F.split(text, "\n"), 1)
    pattern = r"clang version (\d+)\.(\d+)"
    major = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1).cast("int"))
    minor = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 2).cast("int"))
    error = F.when(F.length(F.trim(text)) == 0, "EmptyVersion").when(major.isNull(), "UnexpectedVersion").when(major < 9, "AncientVersion")
    return F.struct(major.alias("major"), minor.alias("minor"), error.alias("error"))


def compiler_probe(status: Column, output: Column) -> Column:
    """(major, minor, error) of a run of the compiler that asks for its version: `status` is null if there is no compiler, `output` its bytes.

    Errors besides those of compiler_version: NotFound, BadStatus, NotUtf8.
    """
    found = compiler_version(F.coalesce(F.try_validate_utf8(output.cast("string")), F.lit("")))
    error = F.when(status.isNull(), "NotFound").when(status != 0, "BadStatus").when(~F.is_valid_utf8(output.cast("string")), "NotUtf8").otherwise(found["error"])
    known = lambda part: F.when(error.isNull() | (error == "AncientVersion"), found[part])
    return F.struct(known("major").alias("major"), known("minor").alias("minor"), error.alias("error"))


def _pipe_text(stdout: Column, stderr: Column) -> Column:
    """What a job wrote, by pipe; null if it wrote nothing."""
    said = lambda kind, c: F.when(F.length(c) > 0, F.concat(F.lit(f"non-empty standard {kind}\n---\n"), c, F.lit("---")))
    return F.nullif(F.concat_ws("\nand ", said("output", stdout), said("error", stderr)), F.lit(""))


def job_reports(jobs: DataFrame) -> DataFrame:
    """`jobs` (exit_code, stdout, stderr) with level and message: a non-zero exit is an error, output of a success a warning.

    A null exit_code is a job that a signal ended: an error too.  Null outputs are empty ones; a quiet success has nulls.
    """
    failed = F.coalesce(F.col("exit_code") != 0, F.lit(True))
    said = _pipe_text(F.col("stdout"), F.col("stderr"))
    how = F.concat(F.lit("Job failed with "), F.coalesce(F.concat(F.lit("exit status: "), F.col("exit_code").cast("string")), F.lit("a signal")))
    message = F.when(failed, F.concat(how, F.coalesce(F.concat(F.lit(", it had "), said), F.lit("")))).otherwise(F.concat(F.lit("Job had "), said))
    return jobs.withColumn("level", F.when(failed, "error").when(said.isNotNull(), "warning")).withColumn("message", message)


def attempts(runs: DataFrame) -> DataFrame:
    """(job, n_attempts, n_stopped, finished) from `runs` (job, stopped): a stopped job goes back to the queue and runs again."""
    stopped = F.count(F.when(F.col("stopped"), 1))
    return runs.groupBy("job").agg(F.count("*").alias("n_attempts"), stopped.alias("n_stopped"), (F.count("*") > stopped).alias("finished"))
