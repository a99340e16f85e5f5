"""What a span's detail holds: typing by its form, and shells words."""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LOOP = "<unnamed loop>"

# Fixed value: texts of plain words, as opposed to names of entities.
_A = r"[\p{IsAlphabetic}\p{N}]"
PLAIN_WORDS = rf"^(?:(?:&|memcmp\(\)|{_A}?|{_A}(?:{_A}|[-/]|(?<=-)>|(?<=[^ ]\p{{IsUppercase}})_)*{_A})(?: |$))*$"


def bare(detail: Column) -> Column:
    """Without one pair of parentheses round it."""
    return F.when(detail.startswith("(") & detail.endswith(")") & (F.length(detail) >= 2), detail.substr(F.lit(2), F.length(detail) - 2)).otherwise(detail)


def infer_type(detail: Column) -> Column:
    """Symbol, UnnamedLoop, FilePath, Module, CppEntity or String, the first rule that holds; null for empty or null details."""
    s = bare(detail)
    symbol = s.startswith("_Z") | s.isin("main", "__clang_call_terminate") | s.startswith("__cxx_global_var_init") | s.startswith("_GLOBAL__sub_I_")
    return (
        F.when(F.length(detail) == 0, None)
        .when(symbol, "Symbol")
        .when(s == LOOP, "UnnamedLoop")
        .when(s.startswith("/"), "FilePath")
        .when(detail == "[module]", "Module")
        .when(~F.coalesce(s.rlike(r"^\p{IsUppercase}"), F.lit(False)), "CppEntity")
        .when(s.rlike(PLAIN_WORDS), "String")
        .when(s.isNotNull(), "CppEntity")
    )


def symbol_state(detail: Column) -> Column:
    """Parsed for names that are no mangled ones, else MaybeMangled: symbols are shown as they are."""
    return F.when(bare(detail).isin("main", "__clang_call_terminate"), "Parsed").when(detail.isNotNull(), "MaybeMangled")


def detail_kind(arg_type: Column, detail: Column) -> Column:
    """kind of a parsed argument by its catalogue type: Nothing, String, FilePath, Module, CppEntity, Symbol or UnnamedLoop."""
    path = F.when(detail == "[module]", "Module").when(detail.startswith("/"), "FilePath").otherwise("String")
    loop = F.when(detail == LOOP, "UnnamedLoop").otherwise("String")
    return (
        F.when(detail.isNull(), "Nothing")
        .when(arg_type == "FilePathOrModule", path)
        .when(arg_type.isin("Symbol", "SymbolOpt"), "Symbol")
        .when(arg_type.isin("UnnamedLoop", "UnnamedLoopOpt"), loop)
        .otherwise(arg_type)
    )


def detail_error(arg_type: Column, detail: Column) -> Column:
    """BadFilePath or UnexpectedLoopName for details that their type does not allow; such details are shown as text."""
    return F.when((arg_type == "FilePathOrModule") & (detail != "[module]") & ~detail.startswith("/"), "BadFilePath").when(arg_type.isin("UnnamedLoop", "UnnamedLoopOpt") & (detail != LOOP), "UnexpectedLoopName")


def split_words(command: str | None) -> list[str] | None:
    """The words of one command line; None where a quote stays open."""
    try:
        return None if command is None else shlex.split(command)
    except ValueError:
        return None


@F.pandas_udf(ArrayType(StringType()))
def _words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for commands in batches:
        yield pd.Series([split_words(s) for s in commands], dtype=object)


def shell_words(command: Column) -> Column:
    """The words of a command line as a POSIX shell splits them; null where a quote stays open."""
    simple = F.filter(F.split(command, r"[ \t\n]+"), lambda x: x != "")
    return F.when(command.rlike(r"""["'\\#]"""), _words(command)).otherwise(simple)
