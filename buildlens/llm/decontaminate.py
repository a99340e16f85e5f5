"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Benchmark items are cut into overlapping segments of bounded length.  Of every few consecutive
n-grams of a segment the rarest in the corpus are its seeds, so any long enough part of
a segment keeps some whatever its overall frequency.  A document passage round a seed is
aligned with the segment; the score is the share of the best possible local alignment.
A passage counts by its score, or by its words: enough of them are a quote of any item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import bound_batches, column, slices, table
from buildlens.llm.textops import ngram_hashes, word_hashes

NGRAM = 3
SEGMENT, STRIDE = 128, 64  # words of a segment at most, and from one to the next in a longer item
GROUP, PER_GROUP = 4, 2  # of so many consecutive n-grams, so many rarest are seeds
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.4
ENOUGH = 30  # so many matching words are a match whatever their share
#: Words of the benchmark that are searched in one pass; a larger benchmark takes more passes.
BLOCK_WORDS = 1 << 20
#: Pairs of a word of a text and a seed that are laid out at once.
PAIRS_AT_ONCE = 1 << 20
_BITS = 22


@dataclass
class Block:
    """Segments of some items, and their n-grams sorted by hash."""

    item: np.ndarray  # row of each segment's item
    words: np.ndarray
    rows: np.ndarray  # word offsets of the segments
    gram: np.ndarray
    segment: np.ndarray
    position: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Block:
        h, rows = word_hashes(texts)
        item, begin, end = [], [], []
        for i in range(len(rows) - 1):
            n = int(rows[i + 1] - rows[i])
            if not n:
                continue
            last = max(n - SEGMENT, 0)
            for a in [*range(0, last, STRIDE), last]:
                item.append(i)
                begin.append(int(rows[i]) + a)
                end.append(int(rows[i]) + min(a + SEGMENT, n))
        h = np.concatenate([h[:0], *(h[a:b] for a, b in zip(begin, end))])
        seg_rows = np.concatenate([[0], np.cumsum(np.array(end, np.int64) - np.array(begin, np.int64))]).astype(np.int64)
        gram, at = ngram_hashes(h, seg_rows, NGRAM)
        owner = np.repeat(np.arange(len(item)), np.diff(at))
        position = np.arange(len(gram)) - np.repeat(at[:-1], np.diff(at))
        order = np.lexsort((position, owner, gram))
        return Block(np.array(item, dtype=np.int64), h, seg_rows, gram[order], owner[order], position[order])

    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << _BITS, dtype=bool)
        out[self.gram >> np.uint64(64 - _BITS)] = True
        return out

    def rarest(self, keys: np.ndarray, counts: np.ndarray) -> Block:
        """Only the seeds, given the corpus counts of n-grams (absent: 0)."""
        at = np.minimum(np.searchsorted(keys, self.gram), max(len(keys) - 1, 0))
        n = np.where(keys[at] == self.gram, counts[at], 0) if len(keys) else np.zeros(len(self.gram), np.int64)
        group = self.position // GROUP
        order = np.lexsort((self.position, n, group, self.segment))
        s, g = self.segment[order], group[order]
        first = np.append(True, (s[1:] != s[:-1]) | (g[1:] != g[:-1])) if len(order) else np.zeros(0, bool)
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
        keep = np.sort(order[rank < PER_GROUP])
        return Block(self.item, self.words, self.rows, self.gram[keep], self.segment[keep], self.position[keep])

    def find(self, grams: np.ndarray, bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into grams, index into the block's grams) of all equal pairs, so many at once that memory stays bounded.

        A gram that is common in the text and in the block has very many pairs; a part holds
        those of PAIRS_AT_ONCE and of one more gram at most.
        """
        some = np.flatnonzero(bitmap[grams >> np.uint64(64 - _BITS)])
        lo, hi = np.searchsorted(self.gram, grams[some]), np.searchsorted(self.gram, grams[some], side="right")
        hit = hi > lo
        some, lo, n = some[hit], lo[hit], (hi - lo)[hit]
        part = np.cumsum(n) // PAIRS_AT_ONCE
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for s, a, m in zip(np.split(some, cuts), np.split(lo, cuts), np.split(n, cuts)):
            yield np.repeat(s, m), np.repeat(a, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)


def local_alignment(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best score, end of the alignment in b) of paired sequences, all pairs at once.

    Rows go over a; a row's chain of gaps along b is a running maximum.
    """
    n, la, lb = len(a), max(map(len, a)), max(map(len, b))
    x, y = np.zeros((n, la), np.uint64), np.zeros((n, lb), np.uint64)
    inx, iny = np.zeros((n, la), bool), np.zeros((n, lb), bool)
    for i in range(n):
        x[i, : len(a[i])], inx[i, : len(a[i])] = a[i], True
        y[i, : len(b[i])], iny[i, : len(b[i])] = b[i], True
    ramp = np.arange(1, lb + 1, dtype=np.int32) * GAP
    h = np.zeros((n, lb + 1), dtype=np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for r in range(la):
        same = (x[:, r, None] == y) & iny & inx[:, r, None]
        t = np.maximum(h[:, :-1] + np.where(same, MATCH, MISMATCH), h[:, 1:] + GAP)
        t = np.maximum(t, 0)
        t[~iny] = 0
        h[:, 1:] = np.maximum.accumulate(t - ramp, axis=1) + ramp
        np.maximum(h, 0, out=h)
        k = h[:, 1:].argmax(axis=1)
        v = h[np.arange(n), k + 1]
        up = (v > best) & inx[:, r]
        best[up], end[up] = v[up], k[up] + 1
    return best, end


def matches(texts: pa.Array, block: Block, bitmap: np.ndarray, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """row, item, score, begin, end (words of the text) of the aligned passages: the best a (row, item)."""
    h, rows = word_hashes(texts)
    grams, at = ngram_hashes(h, rows, NGRAM)
    sizes = np.diff(block.rows)
    found = np.zeros((0, 3), np.int64)
    for g, k in block.find(grams, bitmap):
        row, seg = np.searchsorted(at, g, side="right") - 1, block.segment[k]
        bucket = (g - at[row] - block.position[k]) // np.maximum(sizes[seg], 1)
        found = np.unique(np.concatenate([found, np.stack([row, seg, bucket], axis=1)]), axis=0)
    out: dict[tuple[int, int], tuple] = {}
    for cut in range(0, len(found), 256):
        part = found[cut : cut + 256]
        a, b, begins = [], [], []
        for r, s, q in part.tolist():
            n = int(block.rows[s + 1] - block.rows[s])
            lo = max(0, q * n - n // 2)
            hi = min(int(rows[r + 1] - rows[r]), (q + 2) * n + n // 2)
            a.append(block.words[block.rows[s] : block.rows[s + 1]])
            b.append(h[rows[r] + lo : rows[r] + hi])
            begins.append(lo)
        best, end = local_alignment(a, b)
        score = best / (MATCH * np.array([len(x) for x in a]))
        good = np.flatnonzero((score >= threshold) | (best >= MATCH * ENOUGH))
        if not len(good):
            continue
        _, back = local_alignment([a[i][::-1] for i in good], [b[i][: end[i]][::-1] for i in good])
        for i, length in zip(good.tolist(), back.tolist()):
            key = (int(part[i, 0]), int(block.item[part[i, 1]]))
            value = (float(score[i]), -(begins[i] + int(end[i]) - length), begins[i] + int(end[i]))
            out[key] = max(out.get(key, value), value)
    keys = sorted(out)
    return {
        "row": np.array([r for r, _ in keys], dtype=np.int64), "item": np.array([i for _, i in keys], dtype=np.int64), "score": np.array([out[k][0] for k in keys], dtype=np.float64),
        "begin": np.array([-out[k][1] for k in keys], dtype=np.int64), "end": np.array([out[k][2] for k in keys], dtype=np.int64),
    }


def _blocks(docs: DataFrame, items: DataFrame) -> Iterator[tuple[Block, list]]:
    """The benchmark by blocks of bounded size, each with its seeds chosen by corpus counts."""
    items = items.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text").where("text is not null").distinct()
    words = items.agg(F.sum(F.size(F.split("text", "[ \\t-\\r]+")))).first()[0] or 0
    n = -(-words // BLOCK_WORDS)
    for k in range(n):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        block = Block.of(got["text"].combine_chunks())
        if not len(block.gram):
            continue

        def count(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            bitmap, keys = block.bitmap(), np.unique(block.gram)
            for batch in batches:
                for part in slices(batch, "__text"):
                    h, rows = word_hashes(column(part, "__text"))
                    grams, _ = ngram_hashes(h, rows, NGRAM)
                    some = grams[bitmap[grams >> np.uint64(64 - _BITS)]]
                    at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
                    k, c = np.unique(some[keys[at] == some], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["gram", "n"])

        counts = docs.select("__text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        keys = counts["gram"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        yield block.rarest(keys[order], counts["n"].to_numpy()[order]), got["item_id"].to_pylist()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, begin_word, end_word: a row a document row and item found in it.

    The score is that of the best local alignment of a segment of the item (match 2,
    mismatch and gap -1) over twice the segment's words; 1 is a whole exact copy.  Scores
    below the threshold are of passages worth ENOUGH matching words, of long items.
    Documents with null or empty texts match nothing, nor do items of fewer than 3 words.
    Repeated items count once; repeated documents give repeated rows; a null doc_id stays null.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, score double, begin_word bigint, end_word bigint"
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) __text")
    out = spark.createDataFrame([], schema)
    for block, ids in _blocks(rows, items):
        shared = spark.sparkContext.broadcast((block, pa.array(ids, pa.int64())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, item_ids = shared.value
            bitmap = block.bitmap()
            for batch in batches:
                for part in slices(batch, "__text"):
                    m = matches(column(part, "__text"), block, bitmap, threshold)
                    yield pa.RecordBatch.from_arrays([column(part, "doc_id").take(pa.array(m["row"])), item_ids.take(pa.array(m["item"])), *(pa.array(m[k]) for k in ("score", "begin", "end"))], names=["doc_id", "item_id", "score", "begin_word", "end_word"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` without a passage of any item, all columns as they are."""
    bound_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) __text")
    out = docs
    for block, _ in _blocks(rows, items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bitmap = shared.value.bitmap()
            for batch in batches:
                for part in slices(batch, "text"):
                    clean = np.ones(part.num_rows, dtype=bool)
                    clean[matches(column(part, "text"), shared.value, bitmap, threshold)["row"]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {"op2_decontaminate": op2_decontaminate}
