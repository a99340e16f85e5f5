"""Vectorised word, shingle and line primitives over Arrow string columns.

Everything here works on one Arrow batch inside a Spark task: the UTF-8 buffer of
the batch is viewed as a numpy byte array, so splitting, case folding and hashing
cost a few array passes instead of a Python loop over words.

A *word* is a maximal run of bytes other than space and 0x09-0x0D.  Those bytes
never occur inside a multi-byte UTF-8 sequence, so byte runs equal code point runs.
Hashes are 64 bit; 0 marks nothing special.  Nulls count as empty texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWERED = LOWER.tobytes()

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd value for every byte: sums of them with powers of an odd factor are the raw hashes.
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, factor = 1, base & (2**64 - 1)
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(factor)
        done += step
        factor = factor * factor & (2**64 - 1)
    return out


_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 2**64)
_POW: dict[str, np.ndarray] = {"up": _powers(_BASE, 1 << 16), "down": _powers(_BASE_INV, 1 << 16)}


def _pow(kind: str, n: int) -> np.ndarray:
    if len(_POW[kind]) < n:
        size = 1 << (n - 1).bit_length()
        _POW[kind] = _powers(_BASE if kind == "up" else _BASE_INV, size)
    return _POW[kind]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_array(col) -> pa.Array:
    """One contiguous string array with offsets from 0; nulls become empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type)):
        arr = arr.cast(pa.string())
    return pc.fill_null(arr, "") if arr.null_count else arr


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, offsets starting at 0."""
    arr = as_array(arr)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    buffers = arr.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: byte range of each, and the range of words of each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray  # len(batch) + 1 offsets into start/end

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.per_row)


def split_words(arr: pa.Array, lower: bool = True) -> Words:
    data, offsets = utf8(arr)
    if lower:
        data = np.frombuffer(data.tobytes().translate(_LOWERED), np.uint8)
    inside = (data != 0x20) & (data - np.uint8(9) > 4)
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    edge[firsts] |= inside[firsts]  # a row begins a word of its own
    start = np.flatnonzero(edge)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    last[lasts] |= inside[lasts]
    end = np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    n = len(data)
    total, up = np.zeros(n + 1, dtype=np.uint64), _pow("up", n)
    block = np.empty(min(n, 1 << 16), dtype=np.uint64)  # stays in the cache
    for at in range(0, n, 1 << 16):
        to = min(at + (1 << 16), n)
        x = np.take(_BYTE, data[at:to], out=block[: to - at], mode="clip")  # bytes are no index beyond it
        x *= up[at:to]
        x[:1] += total[at : at + 1]
        np.cumsum(x, out=total[at + 1 : to + 1])
    raw = (total[end] - total[start]) * _pow("down", n + 1)[start]
    return mix64(raw + (end - start).astype(np.uint64) * _MULT)


def word_hashes(arr: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each row's words)."""
    w = split_words(arr, lower)
    return hash_ranges(w.data, w.start, w.end), w.rows


def ngram_hashes(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, row by row, and the rows' offsets into them."""
    counts = np.maximum(np.diff(rows) - n + 1, 0)
    out_rows = np.concatenate([[0], np.cumsum(counts)])
    if out_rows[-1] == 0:
        return np.zeros(0, np.uint64), out_rows
    pos = np.arange(out_rows[-1]) - np.repeat(out_rows[:-1] - rows[:-1], counts)
    return mix64(_polynomials(h, n)[pos]), out_rows


def _polynomials(h: np.ndarray, n: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Sum of h[i + k] * base**(n - 1 - k) modulo 2**64 for every i, from sums over 1, 2, 4 ... words."""
    out, done, run, width = None, 0, np.asarray(h, np.uint64), 1
    while True:
        if n & width:
            out = run if out is None else out[: len(h) - done - width + 1] * np.uint64(pow(base, width, 2**64)) + run[done:]
            done += width
        if done == n:
            return out
        run, width = run[:-width] * np.uint64(pow(base, width, 2**64)) + run[width:], 2 * width


def shingle_sets(h: np.ndarray, rows: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every row, and offsets.

    A row with fewer than n words but at least one gives its whole sequence as one
    shingle; a row without words gives none.
    """
    grams, offs = ngram_hashes(h, rows, n)
    per = np.diff(rows)
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        seed = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            has = per[short] > k
            at = np.where(has, rows[short] + k, rows[short])
            seed = np.where(has, seed * np.uint64(0x9FB21C651E98DF25) + h[at], seed)
        grams = np.insert(grams, offs[short], mix64(seed + per[short].astype(np.uint64)))
        offs = offs + np.searchsorted(short, np.arange(len(offs)))
    grams = sorted_rows(grams, offs)
    keep = np.ones(len(grams), dtype=bool)
    keep[1:] = grams[1:] != grams[:-1]
    keep[offs[:-1][np.diff(offs) > 0]] = True  # a row begins anew
    return grams[keep], np.concatenate([[0], np.cumsum(keep)])[offs].astype(np.int64)


def sorted_rows(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The values sorted within each row: rows of like sizes as one matrix, filled up with the largest value."""
    out, size = np.empty_like(values), np.diff(offs)
    kind = np.frexp(np.maximum(size - 1, 0).astype(np.float64))[1]
    for k in np.unique(kind):
        these = np.flatnonzero((kind == k) & (size > 0))
        step = max((1 << 20) >> int(k), 1)  # a matrix has a million cells, or one row
        for at in range(0, len(these), step):
            some = these[at : at + step]
            column = np.arange(size[some].max())
            inside = column < size[some][:, None]
            place = (offs[some][:, None] + column)[inside]
            block = np.full(inside.shape, np.iinfo(values.dtype).max, values.dtype)
            block[inside] = values[place]
            block.sort(axis=1)
            out[place] = block[inside]
    return out


def segment_reduce(ufunc, values: np.ndarray, offsets: np.ndarray, empty=0):
    """ufunc.reduceat that is right for empty segments."""
    n = len(offsets) - 1
    out = np.full(n, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, offsets[full])
    return out
