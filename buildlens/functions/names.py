"""Long C++ entity names in few columns, by the depth of their bracketed lists.

A name is a text with nested lists in <>, (), [] and {}.  Its rendering at depth d
shows lists down to d and puts an ellipsis for what lies in deeper ones; the scopes
in front of the last name give way likewise at depth 0.  The bounded form is the
deepest rendering that fits.  This is a rule on brackets, not a parser of the language:
names keep their spelling.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from buildlens.functions.text import ELLIPSIS, is_ascii, width

_OPEN, _CLOSE = "<([{", ">)]}"
#: Operator names and arrows hold brackets that open or close nothing.
_TOKEN = re.compile(r"operator\s*(?:\(\)|\[\]|<=>|->\*?|<<=?|>>=?|<=|>=|<|>)|->\*?|\(anonymous(?: [a-z]+)?\)|<unknown>|[<>()\[\]{}]|'(?:\\.|[^'\\])'|[^<>()\[\]{}\-o'(]+|.", re.S)


def pieces(name: str) -> list[tuple[str, int]]:
    """(text, depth) of the tokens; brackets have the depth of what they enclose.  Unmatched ones count as plain text."""
    out: list[list] = []
    stack: list[int] = []
    for m in _TOKEN.finditer(name):
        t = m[0]
        if t in _OPEN and len(t) == 1:
            stack.append(len(out))
            out.append([t, len(stack)])
        elif t in _CLOSE and len(t) == 1:
            if stack and out[stack[-1]][0] == _OPEN[_CLOSE.index(t)]:
                out.append([t, len(stack)])
                stack.pop()
            else:
                out.append([t, len(stack)])
        else:
            out.append([t, len(stack)])
    if stack:  # never closed: the list is not one
        for k in stack:
            for x in out[k:]:
                x[1] -= 1
    return [(t, max(d, 0)) for t, d in out]


def rendering(parts: list[tuple[str, int]], depth: int) -> str:
    """Lists deeper than `depth` as brackets round an ellipsis; empty lists stay."""
    out: list[str] = []
    hidden = False
    for text, d in parts:
        if d <= depth:
            out.append(text)
            hidden = False
        elif d == depth + 1 and text in _OPEN + _CLOSE and len(text) == 1:
            if text in _CLOSE and hidden:
                out.append(ELLIPSIS)
            hidden = False
            out.append(text)
        elif not text.isspace():
            hidden = True
    return "".join(out)


def renderings(name: str) -> list[str]:
    """The name at every depth, least first; the last is the name itself."""
    parts = pieces(name)
    deepest = max((d for _, d in parts), default=0)
    flat = rendering(parts, 0)
    head = flat.rsplit("::", 1)
    least = f"{ELLIPSIS}::{head[1]}" if len(head) == 2 and head[0] else flat
    out = [least] + [rendering(parts, d) for d in range(deepest)]
    return [x for k, x in enumerate([*out, name]) if k == 0 or x != out[k - 1]]


def bounded(name: str, cols: int) -> str:
    """The deepest rendering that fits into `cols` columns, up to the first that doesn't; an ellipsis if none does."""
    return _last_fitting(renderings(name), cols)


def _last_fitting(texts: Iterable[str], cols: int) -> str:
    best = ELLIPSIS
    for text in texts:
        if width(text) > cols:
            break
        best = text
    return best


@F.pandas_udf(ArrayType(StringType()))
def _renderings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for names in batches:
        codes, uniques = pd.factorize(names)
        done = [renderings(n) for n in uniques]
        yield pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)


def entity_renderings(name: Column) -> Column:
    return _renderings(name)


@F.pandas_udf(StringType())
def _fitting(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for all_, cols in batches:
        yield pd.Series([None if r is None else _last_fitting(r, int(c)) for r, c in zip(all_, cols)], dtype=object)


def bounded_entity(all_renderings: Column, cols: int | Column) -> Column:
    """Of an array of renderings, the last before the first that is wider than `cols` terminal columns.

    With one budget for all rows, renderings of ASCII alone are measured by their lengths, without Python.
    """
    if isinstance(cols, Column):
        return _fitting(all_renderings, cols)
    plain = ~F.exists(all_renderings, lambda x: ~is_ascii(F.replace(x, F.lit(ELLIPSIS), F.lit("."))))
    start = F.struct(F.lit(ELLIPSIS).alias("best"), F.lit(False).alias("stop"))

    def step(acc: Column, text: Column) -> Column:
        stop = acc["stop"] | (F.length(text) > cols)
        return F.struct(F.when(stop, acc["best"]).otherwise(text).alias("best"), stop.alias("stop"))

    by_length = F.aggregate(all_renderings, start, step, lambda acc: acc["best"])
    return F.when(all_renderings.isNull(), None).when(plain, by_length).otherwise(_fitting(F.when(~plain, all_renderings), F.lit(cols)))
