"""Byte-level BPE ids of whole texts, batch-wise.

The pre-tokeniser never joins a non-space with a following space, so a text splits
exactly into chunks "spaces, then non-spaces" that encode on their own.  Words repeat:
each distinct chunk of a batch is encoded once and the ids are laid out by numpy.
Texts with white space outside ASCII, which the pre-tokeniser also knows, are encoded
as they are.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from buildlens.llm.textops import SPACE, as_array, hash_ranges, utf8

#: Distinct chunks that one worker remembers between batches.
REMEMBERED = 600_000
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """`path` is a ranks file (one base64 token and its id a line); `special` texts have ids of their own."""

    def __init__(self, path: str, special: tuple[tuple[str, int], ...] = ()):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=dict(special))
        self.special = re.compile("|".join(re.escape(t) for t, _ in special)) if special else None
        self.ranks |= {t.encode(): i for t, i in special}
        self.token_bytes = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        for token, i in self.ranks.items():
            self.token_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.ptr = np.zeros(1 << 14, dtype=np.int64)

    def _encode_chunks(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte ranges and the number of ids of each.

        Ranges that begin with a space and end otherwise are encoded in one call:
        no token crosses from one into the next, and token lengths tell them apart.
        Those marked `alone` are encoded one by one, with special texts.
        """
        size = end - start
        plain = SPACE[data[start]] & ~SPACE[data[end - 1]] & ~alone
        some = np.flatnonzero(plain)
        ends = np.cumsum(size[some])
        total = int(ends[-1]) if len(ends) else 0
        joined = data[np.arange(total) + np.repeat(start[some] - (ends - size[some]), size[some])].tobytes().decode("utf-8", "replace")
        ids = self.bpe.encode_to_numpy(joined, disallowed_special=()).astype(np.uint32)
        upto = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, side="right") if total else np.zeros(0, np.int64)
        counts = np.zeros(len(start), dtype=np.int64)
        counts[some] = np.diff(upto, prepend=0)
        rest = np.flatnonzero(~plain)
        own = [self.bpe.encode(data[start[i] : end[i]].tobytes().decode("utf-8", "replace"), allowed_special="all", disallowed_special=()) for i in rest]
        counts[rest] = [len(x) for x in own]
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        is_plain = np.repeat(plain, counts)
        out[is_plain] = ids
        out[~is_plain] = np.array([i for x in own for i in x], dtype=np.uint32)
        return out, counts

    def _learn(self, hashes: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        have, n = len(self.known), len(hashes)
        end = int(self.ptr[have])
        need = end + len(ids)
        if need > len(self.flat):
            self.flat = np.resize(self.flat, max(need, 2 * len(self.flat)))
        if have + n + 1 > len(self.ptr):
            self.ptr = np.resize(self.ptr, max(have + n + 1, 2 * len(self.ptr)))
        self.flat[end:need] = ids
        self.ptr[have + 1 : have + n + 1] = end + np.cumsum(sizes)
        self.known.update(zip(hashes, range(have, have + n)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows' ids)."""
        texts = as_array(texts)
        data, offsets = utf8(texts)
        odd = self._odd_rows(texts, data, offsets)
        space = SPACE[data]
        edge = space.copy()
        edge[1:] &= ~space[:-1]
        edge[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(edge)
        alone = np.zeros(0, dtype=np.int64)
        if len(odd):
            alone = offsets[odd]
            row = np.searchsorted(offsets, start, side="right") - 1
            start = start[~np.isin(row, odd) | np.isin(start, offsets[odd])]
        end = np.append(start[1:], len(data)) if len(start) else start
        uniq, first, inverse = np.unique(hash_ranges(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        hashes = uniq.tolist()
        at = list(map(self.known.get, hashes))
        new = [i for i, x in enumerate(at) if x is None]
        if new:
            at_first = first[np.asarray(new)]
            have = len(self.known)
            self._learn([hashes[i] for i in new], *self._encode_chunks(data, start[at_first], end[at_first], np.isin(start[at_first], alone)))
            for k, i in enumerate(new):
                at[i] = have + k
        which = np.asarray(at, dtype=np.int64)[inverse]
        size = self.ptr[which + 1] - self.ptr[which]
        done = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(done[-1]) + np.repeat(self.ptr[which] - done[:-1], size)]
        return ids, done[np.searchsorted(start, offsets)]

    def _odd_rows(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that are encoded whole: odd white space and special texts join with what stands beside them."""
        lead = np.concatenate([[0], np.cumsum(_LEADS[data], dtype=np.int64)])
        maybe = np.flatnonzero(lead[offsets[1:]] > lead[offsets[:-1]])
        odd = {int(i) for i in maybe if _ODD_SPACE.search(texts[int(i)].as_py())}
        if self.special:
            odd |= set(np.flatnonzero(pc.match_substring_regex(texts, self.special.pattern).to_numpy(zero_copy_only=False)).tolist())
        return np.array(sorted(odd), dtype=np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of consecutive runs of ids."""
        if not hasattr(self, "vocabulary"):
            tokens = sorted(self.ranks, key=self.ranks.get)
            self.vocabulary = np.frombuffer(b"".join(tokens), np.uint8)
            self.token_start = np.zeros(len(self.token_bytes), np.int64)
            self.token_start[[self.ranks[t] for t in tokens]] = np.cumsum([0, *map(len, tokens)])[:-1]
        size = self.token_bytes[ids]
        done = np.concatenate([[0], np.cumsum(size)])
        raw = self.vocabulary[np.arange(done[-1]) + np.repeat(self.token_start[ids] - done[:-1], size)]
        cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(done[offsets].astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
        return cells.cast(pa.large_string()).cast(pa.string())


@lru_cache(maxsize=4)
def encoder(path: str, special: tuple[tuple[str, int], ...] = ()) -> Encoder:
    return Encoder(path, special)


@lru_cache(maxsize=2)
def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The special texts that the tokenizer beside a ranks file knows, which it finds in plain texts too."""
    with open(re.sub(r"\.tiktoken$", ".json", path), encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f).get("added_tokens", []))
