"""Text of durations, sizes and ages, and shortening to a number of columns.

Built-in expressions throughout, but for what needs the width of characters outside
ASCII: that is a pandas function over the distinct texts of a batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

MICROSECOND, MILLISECOND, SECOND, MINUTE, HOUR, DAY = 1.0, 1e3, 1e6, 6e7, 3.6e9, 8.64e10
ELLIPSIS = "…"


def _plain(x: Column) -> Column:
    """Shortest decimal text without an exponent or a closing .0, for values below 1000."""
    text = x.cast("string")
    exact = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(text.contains("E"), exact).otherwise(F.regexp_replace(text, r"\.0$", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed(x: Column, places: int, wide: int = 0) -> Column:
    """`x` (0 or more) with so many decimals, padded with zeros to `wide` characters.

    Rounded by the binary value, ties to even: format_string rounds the shortest decimal
    text, half up, which differs where that text ends in a 5 behind the last place.  There the
    product of x and a power of ten, in two parts without error, tells which side x is on.
    """
    scale = float(10 ** (places + 1))

    def text(v: Column) -> Column:
        k = F.round(v * scale)
        high = v * 134217729.0 - (v * 134217729.0 - v)
        rest = ((high * scale - v * scale) + (v - high) * scale) + (v * scale - k)
        down = (k % 10 == 5) & (k / scale == v) & ((rest < 0) | ((rest == 0) & (F.floor(k / 10) % 2 == 0)))
        return F.format_string(f"%0{wide}.{places}f" if wide else f"%.{places}f", F.when(down, (k - 5) / scale).otherwise(v))

    return let(x.cast("double"), text)


def duration_text(us: Column) -> Column:
    """A duration of `us` microseconds, to two decimals of the unit that fits.

    A unit is left for the next one where rounding would reach it: 59.995 s is 1:00.00.
    Below a millisecond all digits are shown.  Null gives null.
    """
    near = 0.005 * SECOND  # what two decimals round up

    def split(x: Column, unit: float, head: Callable[[Column], Column], tail: Callable[[Column], Column]) -> Column:
        """Whole units, and the rest; a rest that rounds up to a unit is one."""
        return let(F.floor((x + near) / unit), lambda n: F.concat(head(n), tail(F.greatest(x - n * unit, F.lit(0.0)))))

    text = lambda form: lambda n: F.format_string(form, n)
    seconds = lambda x: fixed(x / SECOND, 2, 5)
    minutes = lambda form: lambda x: split(x, MINUTE, text(form), seconds)
    hours = lambda form: lambda x: split(x, HOUR, text(form), minutes("%02d:"))
    return (
        F.when(us >= DAY - near, split(us, DAY, text("%dd "), hours("%02d:")))
        .when(us >= HOUR - near, hours("%d:")(us))
        .when(us >= MINUTE - near, minutes("%d:")(us))
        .when(us >= 0.999995 * SECOND, F.concat(fixed(us / SECOND, 2), F.lit("s")))
        .when(us >= MILLISECOND, F.concat(fixed(us / MILLISECOND, 2), F.lit("ms")))
        .when(us.isNotNull(), F.concat(_plain(us), F.lit("µs")))
    )


def profile_text(us: Column, share: Column) -> Column:
    """` [<duration>, <percent>%]`."""
    return F.concat(F.lit(" ["), duration_text(us), F.lit(", "), fixed(share * 100, 2), F.lit("%]"))


def memory_text(n_bytes: Column) -> Column:
    return F.concat(fixed(n_bytes / 1e9, 2), F.lit(" GB"))


def seconds_text(s: Column) -> Column:
    return F.concat(fixed(s, 1), F.lit("s"))


def age_text(seconds: Column) -> Column:
    """Whole days, else hours, else minutes."""
    days = F.floor(seconds / 86400)
    return F.when(days == 1, "1 day").when(days > 1, F.concat(days.cast("string"), F.lit(" days"))).when(seconds >= 3600, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).when(
        seconds.isNotNull(), F.concat(F.floor(seconds / 60).cast("string"), F.lit("min"))
    )


def width(s: str) -> int:
    """Terminal columns of a text."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def clusters(s: str) -> list[str]:
    """Characters with the marks that follow them."""
    out: list[str] = []
    for c in s:
        if out and (unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me") or c == "‍" or out[-1].endswith("‍")):
            out[-1] += c
        else:
            out.append(c)
    return out


def shortened(s: str, cols: int) -> str:
    """`s`, or its beginning and end round an ellipsis, in at most `cols` columns (1 at least)."""
    if width(s) <= cols:
        return s
    parts = clusters(s)
    head, tail = (cols - 1) // 2, cols - 1 - (cols - 1) // 2
    front, back, used = [], [], 0
    for p in parts:
        if used + width(p) > head:
            break
        front.append(p)
        used += width(p)
    used = 0
    for p in reversed(parts):
        if used + width(p) > tail:
            break
        back.append(p)
        used += width(p)
    return "".join(front) + ELLIPSIS + "".join(reversed(back))


@F.pandas_udf(StringType())
def _shortened(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, cols in batches:
        yield pd.Series([None if t is None else shortened(t, int(c)) for t, c in zip(text, cols)], dtype=object)


def _at_least_one(cols: int | Column) -> Column:
    if isinstance(cols, int):
        if cols < 1:
            raise ValueError("one column at least")
        return F.lit(cols)
    return cols


def shorten_ascii(text: Column, cols: int | Column) -> Column:
    """As shorten, for texts of which a character is a column; nothing but built-in functions."""
    cols = _at_least_one(cols)
    head = F.floor((cols - 1) / 2).cast("int")
    cut = F.concat(F.left(text, head), F.lit(ELLIPSIS), F.right(text, cols - 1 - head))
    return F.when(F.length(text) <= cols, text).otherwise(cut)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def shorten(text: Column, cols: int | Column) -> Column:
    """Text in at most `cols` columns, a number or a column of such, its middle elided where it doesn't fit."""
    cols = _at_least_one(cols)
    return F.when(is_ascii(text) | text.isNull(), shorten_ascii(text, cols)).otherwise(_shortened(F.when(~is_ascii(text), text), cols))


@F.pandas_udf(IntegerType())
def _widths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else width(t) for t in texts], dtype="Int32")


def columns_of(text: Column) -> Column:
    """Terminal columns of a text; only texts beyond ASCII are measured character by character."""
    return F.when(is_ascii(text), F.length(text)).otherwise(_widths(F.when(~is_ascii(text), text)))
