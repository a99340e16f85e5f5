"""HyperMinHash registers: compressed minima, band keys and the corrected Jaccard estimate.

A register keeps, of the least hash of a set under one hash function, its number of
leading zeros (6 bits) and the 10 or 26 bits that follow the leading one.  Two or four
bytes a register hold sets of any size; equal registers of different minima are rare and
their expected share is taken out of the estimate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from buildlens.llm.textops import mix64, segment_reduce

SHORT, LONG = 10, 26  # mantissa bits of registers of two and of four bytes
MOST = 256  # registers at most

_seeds = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 2 * MOST, dtype=np.uint64)
_MUL = _seeds[:MOST] * np.uint64(2) + np.uint64(1)
_XOR = _seeds[MOST:]


def tuned_bands(rows: int, similarity: float, recall: float) -> int:
    """Bands of so many rows with which a pair of that similarity meets with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


@dataclass(frozen=True)
class Banding:
    """Registers in bands, and the least estimate at which a pair is still compared in full."""

    rows: int
    bands: int
    least: float
    mantissa: int = SHORT

    @property
    def registers(self) -> int:
        return self.rows * self.bands

    @property
    def dtype(self) -> type:
        return np.uint16 if self.mantissa == SHORT else np.uint32

    @staticmethod
    def tuned(rows: int, similarity: float, recall: float, mantissa: int = SHORT, deviations: float = 4.5) -> Banding:
        bands = tuned_bands(rows, similarity, recall)
        return Banding(rows, bands, similarity - deviations * math.sqrt(similarity * (1 - similarity) / (rows * bands)), mantissa)


def compress(least: np.ndarray, mantissa_bits: int = SHORT) -> np.ndarray:
    """64-bit minima to registers of 6 + mantissa_bits bits: leading zeros, then mantissa."""
    least = np.maximum(least, np.uint64(1))
    _, exponent = np.frexp(least.astype(np.float64))
    exponent = exponent.astype(np.int64)  # bit length, or one more after rounding up
    wrong = (exponent > 64) | ((least >> np.minimum(exponent - 1, 63).astype(np.uint64)) == 0)
    exponent = np.where(wrong, exponent - 1, exponent)
    top = least << (64 - exponent).astype(np.uint64)  # leading one in the highest place
    kind = np.uint16 if mantissa_bits == SHORT else np.uint32
    mantissa = (top << np.uint64(1)) >> np.uint64(64 - mantissa_bits)
    return ((64 - exponent).astype(kind) << kind(mantissa_bits)) | mantissa.astype(kind)


def signatures(grams: np.ndarray, rows: np.ndarray, banding: Banding) -> np.ndarray:
    """(sets, registers) of banding.dtype; an empty set has all bits of all registers set."""
    n, registers = len(rows) - 1, banding.registers
    full = np.uint64(2**64 - 1)
    out = np.empty((n, registers), dtype=banding.dtype)
    # Blocks of about 2**15 shingles stay in the cache while all registers pass over them.
    cut = 0
    while cut < n:
        to = max(cut + 1, int(np.searchsorted(rows, rows[cut] + (1 << 15), side="right")) - 1)
        part, offs = grams[rows[cut] : rows[to]], rows[cut : to + 1] - rows[cut]
        least = np.empty((registers, to - cut), dtype=np.uint64)
        for k in range(registers):
            v = (part ^ _XOR[k]) * _MUL[k]
            v ^= v >> np.uint64(32)
            v *= np.uint64(0x9E3779B97F4A7C15)
            least[k] = segment_reduce(np.minimum, v, offs, full)
        block = compress(least.T, banding.mantissa)
        block[np.diff(offs) == 0] = np.iinfo(banding.dtype).max
        out[cut:to] = block
        cut = to
    return out


def band_keys(sig: np.ndarray, band_rows: int) -> np.ndarray:
    """(sets, bands) int64 keys that differ between bands."""
    n, k = sig.shape
    bands = k // band_rows
    rows = sig[:, : bands * band_rows].reshape(n, bands, band_rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for j in range(band_rows):
        key = mix64(key * np.uint64(0x2545F4914F6CDD1D) + rows[:, :, j])
    return key.view(np.int64)


def accidental(n: np.ndarray, m: np.ndarray, mantissa: int = SHORT) -> np.ndarray:
    """Expected share of equal registers of two sets without a common element."""
    n, m = np.asarray(n, np.float64), np.asarray(m, np.float64)
    return 0.7213 / 2**mantissa * n * m / np.maximum(n + m, 1.0) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, mantissa: int = SHORT) -> np.ndarray:
    """Jaccard estimates of paired signatures, corrected for accidental matches."""
    share = (a == b).mean(axis=-1)
    e = accidental(n, m, mantissa)
    return np.clip((share - e) / (1 - e), 0.0, 1.0)
