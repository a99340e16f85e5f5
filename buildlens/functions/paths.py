"""Paths: normal form, relation to a folder, shortening to a number of columns."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from buildlens.functions.text import ELLIPSIS, clusters, width

#: Least columns of a file name that is cut in its middle, and of the marks round it.
LEAST_NAME, MARKS = 15, 2


def components(path: Column) -> Column:
    """['/', part, ...] of an absolute path; . goes, .. takes the part before it but never the root.  Null for relative paths."""
    start = F.array(F.lit("/"))
    step = lambda acc, c: F.when((c == "") | (c == "."), acc).when(c == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(c)))
    return F.when(path.startswith("/"), F.aggregate(F.split(path, "/"), start, step))


def joined(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))


def normalized(path: Column) -> Column:
    """An absolute path in normal form; null for relative paths (see path_error)."""
    return joined(components(path))


def path_error(path: Column) -> Column:
    return F.when(~path.startswith("/"), F.lit("RelativePath"))


@F.pandas_udf(StringType())
def _relative(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for path, base in batches:
        yield pd.Series([None if p is None or b is None else posixpath.relpath(p, b) if p.startswith("/") and b.startswith("/") else p for p, b in zip(path, base)], dtype=object)


def relative_to(path: Column, base: Column) -> Column:
    """`path` seen from the folder `base`; unchanged where either is relative."""
    return _relative(path, base)


def shortened_path(parts: list[str], cols: int) -> str:
    """A path in at most `cols` columns: whole parts from both ends, the file name first, an ellipsis between.

    Ends take turns, back first, until neither has a part that still fits; a file name
    that is too long by itself is cut in its middle if enough of it remains.
    """
    absolute = parts[:1] == ["/"]
    names = parts[1:] if absolute else list(parts)
    whole = ("/" if absolute else "") + "/".join(names)
    if width(whole) <= cols:
        return whole
    if not names:
        return ELLIPSIS
    # What stands in front and behind so far, with separators; the root counts as the first part in front.
    heads = (["/"] if absolute else []) + [n + "/" for n in names]
    tails = ["/" + n for n in names]
    room, front, back = cols - width(ELLIPSIS), 0, 0
    stuck = {"back": False, "front": False}
    side = "back"
    while not all(stuck.values()) and front + back < len(heads):
        piece = tails[-1 - back] if side == "back" and back < len(tails) else heads[front] if side == "front" else None
        if piece is not None and width(piece) <= room:
            room -= width(piece)
            front, back = front + (side == "front"), back + (side == "back")
        else:
            stuck[side] = True
            if side == "back" and back == 0:
                break
        other = "front" if side == "back" else "back"
        side = other if not stuck[other] else side
    if back:
        return "".join(heads[:front]) + ELLIPSIS + "".join(tails[len(tails) - back :])
    if cols < LEAST_NAME + MARKS:
        return ELLIPSIS
    return name_cut(names[-1], cols)


def name_cut(name: str, cols: int) -> str:
    """`…/` and a file name with its middle elided, in `cols` columns (3 at least)."""
    parts, room = clusters(name), cols - 3
    front = fitting(parts, room // 2)
    back = fitting(parts[::-1], room - width("".join(front)))
    return f"{ELLIPSIS}/{''.join(front)}{ELLIPSIS}{''.join(reversed(back))}"


def fitting(parts: list[str], room: int) -> list[str]:
    """The first of `parts` that fit into so many columns."""
    out = []
    for p in parts:
        room -= width(p)
        if room < 0:
            break
        out.append(p)
    return out


@F.pandas_udf(StringType())
def _short(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for parts, cols in batches:
        yield pd.Series([None if p is None else shortened_path(list(p), int(c)) for p, c in zip(parts, cols)], dtype=object)


def shorten_path(path: Column, cols: int | Column) -> Column:
    """An absolute path, normalized and shortened; null for relative paths."""
    if isinstance(cols, int) and cols < 1:
        raise ValueError("one column at least")
    return _short(components(path), F.lit(cols) if isinstance(cols, int) else cols)
