"""Fill-in-the-middle rearrangement of whole texts.

A text is cut into units, a word with the white space before it; white space at the end
is a unit of its own.  Two cuts, drawn from a hash of the document's id, give prefix,
middle and suffix, and a marker stands in front of each in the output.

One numpy kernel handles all texts of an Arrow batch together: a table gives the class of
every byte, comparing neighbouring bytes marks the ends of units, sums that start anew at
each document count them, and one search over the ends finds the cuts of all rows.  The
output bytes are gathered in one pass too; no text becomes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import bound_batches, column, slices, table
from buildlens.llm.textops import SPACE, as_array, utf8
from buildlens.llm.textstats import CONTINUATION

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of the texts that are rearranged, and percent of those that begin with the suffix.
RATE, SPM_RATE = 50, 80
PLAIN, PSM, SPM = "plain", "psm", "spm"
_FORMS = np.array([PLAIN, PSM, SPM])


def unit_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units that end at or before each byte, over all rows; units before each row, and before the end).

    The difference of the two restarts the count at every document.
    """
    space = SPACE[data]
    ends = ~space
    ends[:-1] &= space[1:]  # a word ends where white space follows
    full = offsets[1:] > offsets[:-1]
    ends[offsets[1:][full] - 1] = True  # what a document ends in, word or white space, is a unit
    count = np.cumsum(ends, dtype=np.int64)
    return count, np.concatenate([[0], count])[offsets]


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that contain a marker."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    if len(data) >= 3:
        hit = (data[:-2] == 60) & (data[2:] == 62) & np.isin(data[1:-1], list(b"PSM"))
        at = np.flatnonzero(hit)
        row = np.searchsorted(offsets, at, side="right") - 1
        out[row[at + 3 <= offsets[row + 1]]] = True  # one that spans two documents is none
    return out


def rearrange(arr: pa.Array, h: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
    """n, form, prefix_chars, middle_chars, output of a batch; h has four draws a row."""
    data, offsets = utf8(arr)
    size = np.diff(offsets)
    count, before = unit_counts(data, offsets)
    n = np.diff(before)
    plain = (size == 0) | _marked(data, offsets) | (h[:, 2] % 100 >= RATE)
    spm = h[:, 3] % 100 < SPM_RATE
    form = np.where(plain, 0, np.where(spm, 2, 1))
    draws = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
    cuts = np.where(draws > 0, np.searchsorted(count, before[:-1, None] + draws) + 1, offsets[:-1, None])
    begins = np.concatenate([[0], np.cumsum(~CONTINUATION[data], dtype=np.int64)])
    chars = np.diff(begins[np.column_stack([offsets[:-1], cuts])], axis=1)

    # An output is six runs of bytes: marker, part, marker, part, marker, part.  Markers stand before the texts of the batch.
    source = np.concatenate([np.frombuffer(PREFIX + SUFFIX + MIDDLE, dtype=np.uint8), data])
    edges = np.column_stack([offsets[:-1], cuts, offsets[1:]]) + 9
    part = {"P": (edges[:, 0], edges[:, 1]), "M": (edges[:, 1], edges[:, 2]), "S": (edges[:, 2], edges[:, 3])}
    begin, length = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
    for k, (psm_part, spm_part) in enumerate((("P", "S"), ("S", "P"), ("M", "M"))):
        for rows, p in ((form == 1, psm_part), (form == 2, spm_part)):
            begin[rows, 2 * k], length[rows, 2 * k] = 3 * "PSM".index(p), 3
            begin[rows, 2 * k + 1], length[rows, 2 * k + 1] = part[p][0][rows], (part[p][1] - part[p][0])[rows]
    begin[plain, 0], length[plain, 0] = edges[plain, 0], size[plain]
    begin, length = begin.ravel(), length.ravel()
    to = np.concatenate([[0], np.cumsum(length)])
    bytes_ = source[np.arange(to[-1]) + np.repeat(begin - to[:-1], length)]
    out_offsets = to[::6].astype(np.int64)
    output = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(out_offsets.tobytes()), pa.py_buffer(bytes_.tobytes()))
    return {
        "n": n.astype(np.int64), "form": pa.array(_FORMS[form]), "prefix_chars": pa.array(chars[:, 0], mask=plain), "middle_chars": pa.array(chars[:, 1], mask=plain), "output": output.cast(pa.string()),
    }


def draws(doc_id: Column, seed: int) -> Column:
    """The first four 8-digit groups of the hex SHA-256 of `seed:doc_id`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])


def fill_middle(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.

    Null texts are empty ones, which stay plain, as do texts that contain a marker.  Texts of
    any length are cut whole.  Cuts hang on doc_id alone, so rows that repeat come out alike,
    and a null doc_id draws as an empty one does; equal draws leave the middle empty.  An empty
    table gives an empty one; columns other than doc_id and text are not read.
    """
    bound_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), draws(doc_id, seed).alias("__h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                h = column(part, "__h").flatten().to_numpy().reshape(-1, 4)
                got = rearrange(as_array(column(part, "__text")), h)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *[pa.array(v) if isinstance(v, np.ndarray) else v for v in got.values()]], names=["doc_id", *got])

    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A rearranged text has no marker of its own and none can arise where a part meets a marker, so
    the first place of each marker is the right one.
    """
    first = F.when(form == PSM, F.lit(SUFFIX.decode())).otherwise(F.lit(PREFIX.decode()))
    cut, last = F.instr(output, first), F.instr(output, F.lit(MIDDLE.decode()))
    one, two, middle = F.substr(output, F.lit(4), cut - 4), F.substr(output, cut + 3, last - cut - 3), F.substr(output, last + 3)
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || doc_id::varchar) as s from documents),
h as (select *, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4,
  regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from d),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from h),
p as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form,
  array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""


def queries() -> dict:
    return {"op12_fill_middle": op12_fill_middle}


def oracle_sql() -> dict[str, str]:
    return {"op12_fill_middle": OP12_SQL}
