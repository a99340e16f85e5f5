"""Counts over whole texts and over their lines, batch-wise."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from buildlens.llm.textops import SPACE, hash_ranges, ngram_hashes, segment_reduce, split_words, utf8

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
CONTINUATION = np.zeros(256, dtype=bool)
CONTINUATION[0x80:0xC0] = True


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


def repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equals another key of its owner, equals an earlier key of its owner)."""
    order = np.lexsort((np.arange(len(keys)), keys, owner))
    k, o = keys[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    later = np.append(False, same) if len(keys) else np.zeros(0, bool)
    any_ = later | (np.append(same, False) if len(keys) else later)
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order], again[order] = any_, later
    return twice, again


@dataclass
class Stats:
    """Per row: counts.  Per line with a word: row, features of the line."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_bytes: np.ndarray
    shares: dict[str, np.ndarray]
    line_rows: np.ndarray  # offsets of the rows' lines
    lines: dict[str, np.ndarray]


def measure(arr: pa.Array) -> Stats:
    data, offs = utf8(arr)
    w = split_words(arr, lower=False)
    n = len(offs) - 1
    per_row, row_of = w.per_row, w.row_of()
    nbytes = np.diff(offs)
    hashes = hash_ranges(data, w.start, w.end)
    inside = _sums(~SPACE[data] & ~CONTINUATION[data])
    sums = {"symbol": _sums(SYMBOL[data]), "pipe": _sums(data == 124), "bang": _sums(data == 33), "upper": _sums(UPPER[data]), "digit": _sums(DIGIT[data]), "letter": _sums(LETTER[data] & ~CONTINUATION[data])}
    over = lambda s, a, b: s[b] - s[a]

    grams, gram_rows = ngram_hashes(hashes, w.rows, 3)
    gram_owner = np.repeat(np.arange(n), np.diff(gram_rows))
    twice, _ = repeated(grams, gram_owner)
    first = np.arange(len(grams)) + np.repeat(w.rows[:-1] - gram_rows[:-1], np.diff(gram_rows))
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[first[twice] + k] = True
    n_repeat = segment_reduce(np.add, covered.astype(np.int64), w.rows)

    # lines: cut at \n and at row ends, kept if they hold a word
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offs[:-1], breaks + 1])) if n else np.zeros(0, np.int64)
    begin = begin[begin < len(data)]
    end_all = np.append(begin[1:], len(data)) if len(begin) else begin
    end_all = np.where((end_all > begin) & (data[np.maximum(end_all - 1, 0)] == 10), end_all - 1, end_all) if len(begin) else begin
    lw0, lw1 = np.searchsorted(w.start, begin), np.searchsorted(w.start, end_all)
    has = lw1 > lw0
    begin, end, lw0, lw1 = begin[has], end_all[has], lw0[has], lw1[has]
    line_row = np.searchsorted(offs, begin, side="right") - 1
    _, again = repeated(hash_ranges(data, begin, end), line_row)
    line_rows = np.searchsorted(line_row, np.arange(n + 1))
    size = np.maximum(end - begin, 1)
    words = lw1 - lw0
    cov = _sums(covered)
    lines = {k: over(s, begin, end) / size for k, s in sums.items()} | {
        "words": words, "dup": again, "repeat": over(cov, lw0, lw1) / np.maximum(words, 1), "word_bytes": (_sums(~SPACE[data])[end] - _sums(~SPACE[data])[begin]) / np.maximum(words, 1),
        "stop": np.isin(data[np.maximum(w.end[np.maximum(lw1 - 1, 0)] - 1, 0)], list(b".?!:;")) if len(begin) else np.zeros(0, bool),
    }
    twice_w, again_w = repeated(hashes, row_of)
    longest = segment_reduce(np.maximum, w.end - w.start, w.rows)
    no_letter = over(sums["letter"], w.start, w.end) == 0 if len(w.start) else np.zeros(0, bool)
    safe_b, safe_w = np.maximum(nbytes, 1), np.maximum(per_row, 1)
    dup_lines = segment_reduce(np.add, again.astype(np.int64), line_rows)
    shares = {k: over(s, offs[:-1], offs[1:]) / safe_b for k, s in sums.items()} | {
        "log_words": np.log1p(per_row), "word_bytes": segment_reduce(np.add, w.end - w.start, w.rows) / safe_w, "longest": np.log1p(longest), "repeat": n_repeat / safe_w,
        "again": segment_reduce(np.add, again_w.astype(np.int64), w.rows) / safe_w, "no_letter": segment_reduce(np.add, no_letter.astype(np.int64), w.rows) / safe_w,
        "dup_lines": dup_lines / np.maximum(np.diff(line_rows), 1), "line_words": per_row / np.maximum(np.diff(line_rows), 1), "non_ascii": over(_sums(data >= 128), offs[:-1], offs[1:]) / safe_b,
    }
    return Stats(per_row.astype(np.int64), segment_reduce(np.add, over(inside, w.start, w.end), w.rows), over(sums["symbol"], offs[:-1], offs[1:]), dup_lines, n_repeat, nbytes, shares, line_rows, lines)
