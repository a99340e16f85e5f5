"""Language-model scores of documents: prediction by partial matching over bytes.

Counts of (context, byte) pairs of all training documents form a context trie of order
5.  A byte seen after its context costs its share there; otherwise an escape (method D)
leads to the next shorter context, where the bytes already offered are excluded.

The trie is a table of counts that grows with the corpus and is never cut.  The commonest
grams of six bytes (a context and its byte) go to the tasks with their scores; what a
text has besides is joined: grams of the training corpus with their counts, all others
order by order with the nodes of their contexts.  How many go to the tasks changes the
cost, never a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import bound_batches, checkpoint, column, release, slices, table
from buildlens.llm.textops import LOWER, segment_reduce, utf8, word_hashes

ORDER = 5
#: Commonest words and grams that workers look up at hand (16 bytes each); all others are joined.
HEAD_WORDS = 1 << 17
HEAD_GRAMS = 3_000_000

_START, _END = 0xFE, 0xFF  # bytes that UTF-8 never has
_WORD, _GRAM = 0, 1


def _padded(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Grams (context and byte) of the lower-cased texts with their ends, and row offsets."""
    data, offs = utf8(arr)
    data = LOWER[data]
    n = len(offs) - 1
    size = np.diff(offs)
    full = np.full(len(data) + n * (ORDER + 1), _END, dtype=np.uint8)
    begin = offs[:-1] + np.arange(n) * (ORDER + 1)
    for k in range(ORDER):
        full[begin + k] = _START
    full[np.arange(len(data)) + np.repeat(begin + ORDER - offs[:-1], size)] = data
    wide = full.astype(np.uint64)
    gram = wide[ORDER:].copy()
    for k in range(1, ORDER + 1):
        gram |= wide[ORDER - k : len(wide) - k] << np.uint64(8 * k)
    rows = np.concatenate([[0], np.cumsum(size + 1)])
    at = np.arange(rows[-1]) + np.repeat(begin - rows[:-1], size + 1)
    return gram[at], rows


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return values, np.zeros(0, np.int64)
    v = np.sort(values)
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    return v[at], np.diff(np.append(at, len(v)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "__text"):
            text = column(part, "__text")
            for kind, values in ((_WORD, word_hashes(text)[0]), (_GRAM, _padded(text)[0])):
                key, count = _counted(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(count)], names=["kind", "key", "n"])


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted `where`, whether it is there) of every value."""
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


def _spread(grams: np.ndarray, uniq: np.ndarray) -> np.ndarray:
    """The place of each gram in uniq; a small hash table saves most binary searches."""
    bits = max(12, int(len(uniq)).bit_length() + 3)
    mult, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    slot = np.zeros(1 << bits, dtype=np.int32)
    slot[(uniq * mult) >> shift] = np.arange(len(uniq), dtype=np.int32)
    at = slot[(grams * mult) >> shift]
    miss = np.flatnonzero(uniq[at] != grams)
    if len(miss):
        at[miss] = np.searchsorted(uniq, grams[miss])
    return at


def _suffix(key: Column, n_bytes: int) -> Column:
    return key.bitwiseAND((1 << (8 * n_bytes)) - 1)


def _context(key: Column) -> Column:
    return F.shiftrightunsigned(key, 8)


def _levels(grams: DataFrame, order: int) -> list[DataFrame]:
    """key, n of the trie's nodes, order 0 first; the nodes of the full order are the grams themselves."""
    out = [grams]
    for j in range(order - 1, -1, -1):
        out.insert(0, checkpoint(out[0].groupBy(_suffix(F.col("key"), j + 1).alias("key")).agg(F.sum("n").alias("n"))))
    return out


def _seen_scores(grams: DataFrame) -> DataFrame:
    """key, n, lp of the grams of the training corpus: found in their longest context."""
    total = grams.groupBy(_context(F.col("key")).alias("ctx")).agg(F.sum("n").alias("t"))
    return grams.withColumn("ctx", _context(F.col("key"))).join(total, "ctx").select("key", "n", F.log10((F.col("n") - 0.5) / F.col("t")).alias("lp"))


def _unseen_scores(wanted: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """key, lp of grams (column key, distinct) by walking from the longest context to the shortest.

    Of an order only the nodes of contexts that some gram still asks for are summed.
    gone_n and gone_d are the counts and the number of the bytes that are excluded.
    """
    zero = F.lit(0).cast("bigint")
    left = checkpoint(wanted.select("key", F.lit(0.0).alias("lp"), zero.alias("gone_n"), zero.alias("gone_d")))
    done: list[DataFrame] = []
    for j in range(len(levels) - 1, -1, -1):
        here = left.withColumn("node", _suffix(F.col("key"), j + 1)).withColumn("ctx", _context(F.col("node")))
        nodes = levels[j].withColumn("ctx", _context(F.col("key"))).join(here.select("ctx").distinct(), "ctx", "left_semi")
        if j:
            below = levels[j - 1].select(F.col("key").alias("short"), F.col("n").alias("below"))
            nodes = nodes.withColumn("short", _suffix(F.col("key"), j)).join(below, "short")
        else:
            nodes = nodes.withColumn("below", zero)
        sums = nodes.groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("below").alias("excluded"))
        found = levels[j].select(F.col("key").alias("node"), F.col("n").alias("hits"))
        t, d = F.col("t") - F.col("gone_n"), F.col("d") - F.col("gone_d")
        there, hit = F.col("t").isNotNull(), F.col("hits").isNotNull()
        step = F.when(hit, F.log10((F.col("hits") - 0.5) / t)).when(there & (d > 0), F.log10(d / (2 * t))).otherwise(0.0)
        gone_n, gone_d = (F.when(there, new).otherwise(F.col(old)).alias(old) for new, old in ((F.col("excluded"), "gone_n"), (F.col("d"), "gone_d")))
        row = checkpoint(here.join(sums, "ctx", "left").join(found, "node", "left").select("key", (F.col("lp") + step).alias("lp"), gone_n, gone_d, hit.alias("hit")))
        done.append(row.where("hit").select("key", "lp"))
        left = row.where("not hit").drop("hit")
    offered = levels[0].count()  # at most one node a byte
    done.append(left.select("key", (F.col("lp") + math.log10(1 / (256 - offered))).alias("lp")))
    return reduce(DataFrame.union, done)


def _head_threshold(rows: DataFrame, most: int) -> float:
    """The least count, of eight steps an octave, that at most so many rows have: from a histogram, without a sort."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["step"]: r["rows"] for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()}
    done, least = 0, float("inf")
    for k in sorted(sizes, reverse=True):
        done += sizes[k]
        if done > most:
            break
        least = 2.0 ** (k / 8) * (1 - 1e-9)
    return least


def _head(rows: DataFrame, value: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of the `most` commonest rows at most."""
    got = rows.where(F.col("n") >= _head_threshold(rows, most)).select("key", value).toArrow()
    key, v = got["key"].to_numpy(), got[value].to_numpy()
    at = np.argsort(key)
    return key[at].copy(), v[at].copy()


def _tail(found: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The keys that aren't found, a list a row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~found)])[rows].astype(np.int32)), pa.array(keys[~found]))


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    `train` marks the rows to learn from; null counts as true.  Both models take A-Z as
    a-z.  score is the log10 probability of the bytes of a text and its end under the
    trie; base_score that of its words and one end by add-half word counts.  Null texts
    are empty texts (the end alone); rows that repeat count as often as they occur.
    Without training rows score is that of even odds, base_score is 0.  An empty table
    gives an empty one; columns other than id and text are not read.

    Words and grams are joined, but for the `head_words` and `head_grams` commonest
    (tables of bounded size); the scores don't depend on either bound.
    """
    if order != ORDER:
        raise ValueError(f"the order is {ORDER}")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), F.coalesce(train, F.lit(True)).alias("__train"))
    seen = rows.where("__train")
    counts = checkpoint(seen.select("__text").mapInArrow(_count, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    release(docs.sparkSession)
    words, grams = (counts.where(F.col("kind") == kind).select("key", "n") for kind in (_WORD, _GRAM))
    ends = seen.count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_types = total["n"] + ends, total["v"] + (ends > 0)
    denominator = n_tokens + 0.5 * (n_types + 1)
    words = words.withColumn("lp", F.log10((F.col("n") + 0.5) / F.lit(denominator)))
    end_log, end_known = float(np.log10((ends + 0.5) / denominator)), int(ends > 0)
    scored = checkpoint(_seen_scores(grams))
    shared = docs.sparkSession.sparkContext.broadcast((_head(scored, "lp", head_grams), _head(words, "lp", head_words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (gram_key, gram_lp), (word_key, word_lp) = shared.value
        for batch in batches:
            for part in slices(batch, "__text"):
                text = column(part, "__text")
                g, at = _padded(text)
                uniq, _ = _counted(g)
                k, there = _find(gram_key, uniq.view(np.int64))
                lp = np.where(there, gram_lp[k] if len(gram_lp) else 0.0, 0.0)
                place = _spread(g, uniq)
                score, g_found = segment_reduce(np.add, lp[place], at, 0.0), there[place]
                h, w = word_hashes(text)
                h = h.view(np.int64)
                k, found = _find(word_key, h)
                base = segment_reduce(np.add, np.where(found, word_lp[k] if len(word_lp) else 0.0, 0.0), w, 0.0) + end_log
                known = segment_reduce(np.add, found.astype(np.int64), w) + end_known
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(~column(part, "__train").to_numpy(zero_copy_only=False).astype(bool)), pa.array(np.diff(w) + 1), pa.array(known), pa.array(base), pa.array(score), _tail(found, h, w), _tail(g_found, g.view(np.int64), at)],
                    names=["doc_id", "held_out", "n_tokens", "n_head", "head_base", "head_score", "words", "grams"],
                )

    drawn = checkpoint(rows.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_head bigint, head_base double, head_score double, words array<bigint>, grams array<bigint>"))
    drawn = drawn.withColumn("rid", F.monotonically_increasing_id())
    rare = drawn.select("rid", F.explode("grams").alias("key"))
    unseen = rare.select("key").distinct().join(scored, "key", "left_anti")
    score_of = scored.select("key", "lp").unionByName(_unseen_scores(unseen, _levels(grams, order)))
    rare = rare.join(score_of, "key").groupBy("rid").agg(F.sum("lp").alias("tail_score"))
    tail = drawn.select("rid", F.explode("words").alias("key")).join(words, "key", "left")
    tail = tail.groupBy("rid").agg(F.sum(F.coalesce("lp", F.lit(math.log10(0.5 / denominator)))).alias("tail_base"), F.count("lp").alias("n_tail"))
    out = drawn.drop("words", "grams").join(tail, "rid", "left").join(rare, "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_head", "n_tail").alias("n_known"), F.lit(n_tokens).cast("bigint").alias("train_tokens"), plus("head_base", "tail_base").alias("base_score"), plus("head_score", "tail_score").alias("score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)


def queries() -> dict:
    return {"op9_lm_scoring": op9_lm_scoring}
