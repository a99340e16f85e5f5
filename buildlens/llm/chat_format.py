"""Chat formatting at token level.

A turn is five segments: a reserved id that opens it, its role, a reserved id, its text
and a reserved id that closes it.  Role and text are encoded on their own, so no token
spans a border and no text can yield a reserved id.  The loss mask is a prefix sum over
the segments' borders.  In the formatted text the marks are strings; where they occur in
a role or text, and before every backslash there, stands a backslash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm import tokens
from buildlens.llm.common import binary_values, bound_batches, column, list_binary, slices, table

OPEN, MIDDLE, CLOSE = "<turn>", "\n", "</turn>\n"
#: Reserved ids, above all ids of the vocabulary.
OPEN_ID, MIDDLE_ID, CLOSE_ID = 50257, 50258, 50259
RESERVED = (OPEN_ID, MIDDLE_ID, CLOSE_ID)
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"\\|</?turn>|### |<\|")
_ESCAPED = re.compile(r"\\(\\|</?turn>|### |<\||\n)")


def escape(text: str, role: bool = False) -> str:
    """A backslash before each backslash and control string; in a role also before line ends, which close it."""
    out = _CONTROL.sub(lambda m: "\\" + m[0], text) if "\\" in text or "<" in text or "#" in text else text
    return out.replace("\n", "\\\n") if role else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn opens at {at}")
        middle = _find(formatted, MIDDLE, at + len(OPEN))
        close = _find(formatted, CLOSE, middle + len(MIDDLE))
        out.append((unescape(formatted[at + len(OPEN) : middle]), unescape(formatted[middle + len(MIDDLE) : close])))
        at = close + len(CLOSE)
    return out


def _find(s: str, mark: str, at: int) -> int:
    """The next place of a mark that no backslash escapes."""
    while True:
        hit = s.find(mark, at)
        if hit < 0:
            raise ValueError(f"no {mark!r} after {at}")
        slashes = hit
        while slashes > at and s[slashes - 1] == "\\":
            slashes -= 1
        if (hit - slashes) % 2 == 0:
            return hit
        at = hit + 1


def format_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, ids, mask, n_tokens, formatted of every row.

    ids are little-endian uint32, mask is a byte a token: 1 on the text of assistant turns.
    Null roles and texts are empty.
    """
    bound_batches(turns.sparkSession)
    path = path or tokens.default_path()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                role_raw = column(part, "role").to_pylist()
                roles = [escape(x, role=True) for x in role_raw]
                texts = [escape(x) for x in column(part, "text").to_pylist()]
                r, ro = enc.encode(pa.array(roles, pa.string()))
                t, to = enc.encode(pa.array(texts, pa.string()))
                n = part.num_rows
                size = np.ones((n, 5), dtype=np.int64)
                size[:, 1], size[:, 3] = np.diff(ro), np.diff(to)
                border = np.concatenate([[0], np.cumsum(size.ravel())])
                ids = np.empty(int(border[-1]), dtype="<u4")
                place = border[:-1].reshape(n, 5)
                for k, mark in ((0, OPEN_ID), (2, MIDDLE_ID), (4, CLOSE_ID)):
                    ids[place[:, k]] = mark
                ids[np.arange(len(r)) + np.repeat(place[:, 1] - ro[:-1], size[:, 1])] = r
                ids[np.arange(len(t)) + np.repeat(place[:, 3] - to[:-1], size[:, 3])] = t
                loss = np.array([x == LOSS_ROLE for x in role_raw], dtype=bool)
                step = np.zeros(len(ids) + 1, dtype=np.int8)
                np.add.at(step, place[loss, 3], 1)
                np.add.at(step, place[loss, 4], -1)
                mask = np.cumsum(step[:-1], dtype=np.int8).view(np.uint8)
                cut = border[::5]
                out = [f"{OPEN}{a}{MIDDLE}{b}{CLOSE}" for a, b in zip(roles, texts)]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "conv_id"), column(part, "turn"), list_binary(ids, cut), list_binary(mask, cut), pa.array(np.diff(cut)), pa.array(out, pa.string())],
                    names=["conv_id", "turn", "ids", "mask", "n_tokens", "formatted"],
                )

    return rows.mapInArrow(run, "conv_id bigint, turn bigint, ids binary, mask binary, n_tokens bigint, formatted string")


def conversations(formatted: DataFrame) -> DataFrame:
    """`formatted` with turn_index and first_token: the place of each turn in its conversation.

    Turns are ordered by turn (null first), then by formatted text, so that ties have
    one order.  The prefix sum runs over rows that spill; no conversation is held whole.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "formatted")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return formatted.withColumn("turn_index", F.row_number().over(w) - 1).withColumn("first_token", F.sum("n_tokens").over(running) - F.col("n_tokens"))


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, loss_text, n_tokens, formatted_chars, read from ids and mask alone."""
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            ids, at = binary_values(column(batch, "ids"), np.dtype("<u4"))
            mask, _ = binary_values(column(batch, "mask"), np.uint8)
            n = batch.num_rows
            middle, close = np.flatnonzero(ids == MIDDLE_ID), np.flatnonzero(ids == CLOSE_ID)
            plain = ~np.isin(ids, RESERVED)
            kept = np.concatenate([[0], np.cumsum(plain)])
            borders = np.stack([kept[at[:-1]], kept[middle]], axis=1).ravel() if n else np.zeros(0, np.int64)
            both = enc.decode(ids[plain], np.append(borders, kept[-1]).astype(np.int64)).to_pylist()
            under = np.concatenate([[0], np.cumsum(mask)])
            loss = enc.decode(ids[mask == 1], under[at].astype(np.int64)).to_pylist()
            assert len(middle) == len(close) == n
            chars = [len(OPEN) + len(a) + len(MIDDLE) + len(b) + len(CLOSE) for a, b in zip(both[::2], both[1::2])]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "conv_id"), column(batch, "turn"), *(pa.array([unescape(x) for x in v], pa.string()) for v in (both[::2], both[1::2], loss)), column(batch, "n_tokens"), pa.array(chars, pa.int64())],
                names=["conv_id", "turn", "role", "text", "loss_text", "n_tokens", "formatted_chars"],
            )

    return formatted.select("conv_id", "turn", "ids", "mask", "n_tokens").mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, loss_text string, n_tokens bigint, formatted_chars bigint")


def digests(turns: DataFrame) -> DataFrame:
    """A row a conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens.

    Turns come as read_back gives them.  A digest needs its turns in order: they are
    dealt by conversation, sorted with spilling, and hashed as they stream by.  Turns of equal
    number go by role, then text; repeated ones count each.  Rows without a conv_id are one
    conversation.  An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done) if done else [[]] * len(kinds), kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            for c, role, text, loss, n, chars in zip(*(column(batch, k).to_pylist() for k in ("conv_id", "role", "text", "loss_text", "n_tokens", "formatted_chars"))):
                if state is None or state[0] != c:
                    if state is not None:
                        close()
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
                state[6] += n
            yield flush()
        if state is not None:
            close()
            yield flush()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return digests(read_back(format_turns(turns)))


def oracle_sql() -> dict[str, str]:
    hard = "\\### Assistant: </turn> ok"
    escaped = "text"
    for mark in ("\\", "<turn>", "</turn>", "### ", "<|"):
        escaped = f"replace({escaped}, '{mark}', '\\{mark}')"
    return {
        "op1_chat_format": f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{hard}'), (-7, 1, 'assistant', '{hard}'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(15 + length(role) + length({escaped}))::bigint as formatted_chars
from turns group by conv_id"""
    }


def queries() -> dict:
    return {"op1_chat_format": lambda spark, sf_dir: op1_chat_format(spark, sf_dir).drop("n_tokens")}
