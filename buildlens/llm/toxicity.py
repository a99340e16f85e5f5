"""Toxic passages by maximum-scoring segments of token log-odds.

A word's log-odds of standing in a toxic text come from labelled documents.  Words are often
new, so they get them from their stems: counts of a prefix, and at last of the word itself, are
added to a Dirichlet prior whose mean is the shorter prefix, down to the share of all words.

A text is then a walk that rises at toxic words and falls a little at all others.  One linear
scan finds every maximal segment of it (one that cannot gain by growing or shrinking).  How
high a segment rises by chance in a clean text of n words follows an extreme-value law; its
two parameters are fitted to clean labelled texts.  The segments that are significant under
it, and how far the best rises, are turned into a probability by a logistic fit on texts that
had no part in the log-odds they are scored with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import bound_batches, checkpoint, column, slices, table
from buildlens.llm.quality_gam import labelled
from buildlens.llm.textops import LOWER, hash_ranges, mix64, segment_reduce, split_words, utf8
from buildlens.llm.textstats import CONTINUATION, LETTER

#: Labelled documents that the model is fitted on at most (the least hashes of their ids).
SAMPLE = 10_000
#: Stems are prefixes of these many code points; a word is its own last stem.
STEMS = (3, 4, 5, 6, 7, 8)
#: Weight of the prior, in words.
PRIOR = 3.0
#: What a word costs a segment, beside its log-odds; scores are whole multiples of 1 / UNIT.
DRIFT, UNIT = 1.5, 64
#: A segment counts as significant if chance makes as high a one in fewer texts than this.
SIGNIFICANT = 0.05
THRESHOLD = 0.5

_WHOLE = np.uint64(0x5851F42D4C957F2D)


def words_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, begin and end of the letters of every word, offsets of rows): words without letters stay whole."""
    w = split_words(arr)
    data = w.data.copy()
    after = np.flatnonzero(data[:-1] == 0xC3) + 1  # capitals of Latin-1 are two bytes
    high = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    data[high] += 0x20
    letters = np.flatnonzero(LETTER[data])
    lo, hi = np.searchsorted(letters, w.start), np.searchsorted(letters, w.end)
    has = hi > lo
    begin, end = w.start.copy(), w.end.copy()
    begin[has], end[has] = letters[lo[has]], letters[hi[has] - 1] + 1
    return data, begin, end, w.rows


def stems(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keys of every word: one a length of STEMS, 0 where the word is shorter, and the word's own."""
    points = np.flatnonzero(~CONTINUATION[data])
    at = np.searchsorted(points, begin)
    edges = np.concatenate([points, len(data) + np.arange(max(STEMS) + 1)])  # nothing ends behind the last byte
    out = np.zeros((len(begin), len(STEMS) + 1), np.uint64)
    for j, k in enumerate(STEMS):
        to = edges[at + k]
        long = to <= end
        out[long, j] = hash_ranges(data, begin[long], to[long])
    out[:, -1] = mix64(hash_ranges(data, begin, end) ^ _WHOLE)
    return out


@dataclass
class Odds:
    """Counts of the labelled words behind each stem, and the share of toxic documents, the first prior."""

    keys: np.ndarray  # ascending
    n0: np.ndarray  # words of clean documents behind each
    n1: np.ndarray  # and of toxic ones
    share: float

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """Scores of words by their rows of stems, in units: log-odds over those of all words, less the drift.

        Every labelled word counts once: at the longest stem that it shares with the word asked for.
        """
        n = np.zeros((2, len(keys), keys.shape[1] + 1))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = (self.keys[at] == keys) & (keys != 0)
            n[:, :, :-1] = np.where(hit, [self.n0[at], self.n1[at]], 0)
        n = np.maximum.accumulate(n[:, :, ::-1], axis=2)[:, :, ::-1]  # a stem that is too long or unknown adds nothing
        own = n[:, :, :-1] - n[:, :, 1:]
        theta = np.full(len(keys), self.share)
        for j in range(keys.shape[1]):
            theta = (own[1, :, j] + PRIOR * theta) / (own[0, :, j] + own[1, :, j] + PRIOR)
        base = np.log(self.share / (1 - self.share))
        return np.rint(UNIT * (np.log(theta / (1 - theta)) - base - DRIFT)).astype(np.int64)


def token_scores(arr: pa.Array, odds: Odds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score of every word, offsets of rows, begin and end of words); equal words are looked up once."""
    data, begin, end, rows = words_of(arr)
    whole = hash_ranges(data, begin, end)
    _, first, back = np.unique(whole, return_index=True, return_inverse=True)
    return odds.scores(stems(data, begin[first], end[first]))[back], rows, begin, end


def best_rise(scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The highest segment of every row; 0 without a positive word."""
    n = len(rows) - 1
    if not len(scores):
        return np.zeros(n, np.int64)
    total = np.concatenate([[0], np.cumsum(scores)])
    owner = np.repeat(np.arange(n), np.diff(rows))
    deep = int(np.abs(scores).sum()) + 1  # lowers each row below all before it, so that minima start anew
    before, after = total[:-1] - owner * deep, total[1:] - owner * deep
    return np.maximum(segment_reduce(np.maximum, after - np.minimum.accumulate(before), rows), 0)


def segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal scoring segments of a text as (first word, end, score), in linear time.

    Segments are found left to right.  Each remembers the nearest one before it that starts
    lower; it joins with that one if it also ends higher, and the joined segment looks on from
    there, so that each is passed over once.
    """
    total = np.concatenate([[0], np.cumsum(scores)])
    up = scores > 0
    edge = np.diff(np.concatenate([[False], up, [False]]).astype(np.int8))
    held: list[tuple[int, int, int, int, int]] = []  # first, end, low, high, nearest lower start
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        low, high = int(total[a]), int(total[b])
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append((a, b, low, high, j))
                break
            a, low = held[j][0], held[j][2]
            k = held[j][4]
            del held[j:]
            j = k
    return [(a, b, high - low) for a, b, low, high, _ in held]


@dataclass
class Law:
    """Extreme values of clean texts: P(best rise of n words >= s) = 1 - exp(-K n exp(-rate s)), s in units."""

    rate: float
    k: float

    def evidence(self, score: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """How far a score lies above what a clean text of that length reaches, in natural units."""
        return self.rate * score - np.log(self.k * np.maximum(n_words, 1))


def fit_law(rises: np.ndarray, n_words: np.ndarray) -> Law:
    """The likeliest law of the best rises of clean texts."""
    ok = n_words > 0
    s, n = rises[ok].astype(np.float64), n_words[ok].astype(np.float64)
    if not len(s):
        return Law(1.0 / UNIT, 1.0)
    rate = 1.0 / UNIT  # that of log-odds in theory; it stays where clean texts never rise
    lo, hi = 1e-3 / UNIT, 10.0 / UNIT
    for _ in range(80 if s.std() > 0 else 0):  # the derivative of the profile likelihood falls in the rate
        rate = (lo + hi) / 2
        w = n * np.exp(-rate * (s - s.min()))
        if 1 / rate - s.mean() + (w * s).sum() / w.sum() > 0:
            lo = rate
        else:
            hi = rate
    return Law(rate, float(len(s) / (n * np.exp(-rate * s)).sum()))


@dataclass
class Model:
    odds: Odds
    law: Law
    weights: np.ndarray  # of _inputs


def _inputs(n_words: np.ndarray, rise: np.ndarray, found: np.ndarray, total: np.ndarray, law: Law) -> np.ndarray:
    """What the probability is made of: evidence of the best segment, all significant ones, and their density."""
    e = law.evidence(rise, n_words)
    size = np.log1p(n_words)
    return np.column_stack([np.ones(len(e)), e, np.maximum(e, 0.0) ** 0.5, np.log1p(np.maximum(total, 0.0)), np.log1p(found), np.log1p(total / np.maximum(n_words, 1) * 100), size])


def _examine(scores: np.ndarray, rows: np.ndarray, law: Law) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int, int]]]]:
    """(best rise, number of significant segments, their summed evidence, the segments) of every row."""
    n_words = np.diff(rows)
    rise = best_rise(scores, rows)
    least = -np.log(SIGNIFICANT)
    found, total = np.zeros(len(n_words), np.int64), np.zeros(len(n_words))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in n_words]
    for r in np.flatnonzero((n_words > 0) & (law.evidence(rise, n_words) >= least)):
        got = segments(scores[rows[r] : rows[r + 1]])
        value = law.evidence(np.array([s for *_, s in got]), n_words[r])
        spans[r] = [x for x, v in zip(got, value) if v >= least]
        found[r], total[r] = len(spans[r]), value[value >= least].sum()
    return rise, found, total, spans


def _fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def _count_words(sample: DataFrame) -> pa.Table:
    """(key, words of clean and toxic documents of either half) of every stem that two words share, sorted by key.

    At most as many rows as the bounded sample has stems.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                data, begin, end, rows = words_of(column(part, "__text"))
                keys = stems(data, begin, end)
                kind = np.repeat(column(part, "half").to_numpy() * 2 + (column(part, "label").to_numpy() > 0), np.diff(rows))
                known, at = np.unique(keys.ravel(), return_inverse=True)
                counts = np.bincount(at.ravel() * 4 + np.repeat(kind, keys.shape[1]), minlength=4 * len(known)).reshape(-1, 4)
                counts = counts[known != 0]
                yield pa.RecordBatch.from_arrays([pa.array(known[known != 0].view(np.int64)), *[pa.array(c.astype(np.int64)) for c in counts.T]], names=["key", "a0", "a1", "b0", "b1"])

    counted = sample.mapInArrow(run, "key bigint, a0 bigint, a1 bigint, b0 bigint, b1 bigint")
    sums = counted.groupBy("key").agg(*[F.sum(c).cast("int").alias(c) for c in ("a0", "a1", "b0", "b1")])
    return sums.where(F.col("a0") + F.col("a1") + F.col("b0") + F.col("b1") > 1).toArrow()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of at most `sample` labelled documents, the same whatever their partitions.

    Null texts count as empty ones.  Without labels, or with one class only, the score is the
    smoothed share of label 1 for every text.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = checkpoint(labelled(docs, labels, label, sample).withColumn("half", F.pmod(F.xxhash64("__text"), F.lit(2)).cast("int")))  # copies stand in one half
    sizes = {(r["half"], r["toxic"]): r["n"] for r in known.groupBy("half", (F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_all = sum(n for (_, t), n in sizes.items() if t), sum(sizes.values())
    share = lambda halves: (sum(sizes.get((h, True), 0) for h in halves) + 1) / (sum(n for (h, _), n in sizes.items() if h in halves) + 2)
    got = _count_words(known)
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    n = {c: got[c].to_numpy()[order] for c in ("a0", "a1", "b0", "b1")}
    full = Odds(keys[order], n["a0"] + n["b0"], n["a1"] + n["b1"], share((0, 1)))
    if n_toxic in (0, n_all):
        return Model(full, Law(1.0 / UNIT, 1.0), np.array([np.log(full.share / (1 - full.share)), *[0.0] * 6]))
    other = spark.sparkContext.broadcast((Odds(full.keys, n["b0"], n["b1"], share((1,))), Odds(full.keys, n["a0"], n["a1"], share((0,)))))  # by half: the odds of the other

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                for half, odds in enumerate(other.value):
                    own = part.filter(pa.array(column(part, "half").to_numpy() == half))
                    scores, rows, *_ = token_scores(column(own, "__text"), odds)
                    walks = pa.LargeListArray.from_arrays(pa.array(rows), pa.array(scores)).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([column(own, "label"), pa.array(best_rise(scores, rows)), pa.array(np.diff(rows)), walks], names=["label", "rise", "n", "walk"])

    walks = checkpoint(known.mapInArrow(walk, "label int, rise bigint, n bigint, walk array<bigint>"))
    clean = walks.where("label <= 0").select("rise", "n").orderBy("rise", "n").toArrow()
    law = fit_law(clean["rise"].to_numpy(), clean["n"].to_numpy())

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = column(batch, "walk")
            rows = cells.offsets.to_numpy().astype(np.int64)
            rise, found, total, _ = _examine(cells.flatten().to_numpy(), rows - rows[0], law)
            yield pa.RecordBatch.from_arrays([column(batch, "label"), column(batch, "n"), pa.array(rise), pa.array(found), pa.array(total)], names=["label", "n", "rise", "found", "total"])

    seen = walks.mapInArrow(examine, "label int, n bigint, rise bigint, found bigint, total double").orderBy("label", "n", "rise", "found", "total").toArrow()
    x = _inputs(*[seen[c].to_numpy() for c in ("n", "rise", "found", "total")], law)
    return Model(full, law, _fit_weights(x, (seen["label"].to_numpy() > 0).astype(np.float64)))


_PASSAGE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])


def score(docs: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every row.

    `passages` has the significant ones in order: code points from start to end, and how far the
    segment lies above chance.  Null texts are empty ones; texts of any length are scored whole; a
    score equal to the threshold predicts 1.  Equal texts get equal scores, repeated rows repeated
    results; a null `held_out` is false, a null doc_id stays null.  An empty table gives an empty
    one; columns other than doc_id, text and what `held_out` names are not read.
    """
    bound_batches(docs.sparkSession)
    rows_of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "__text"):
                text = column(part, "__text")
                scores, rows, begin, end = token_scores(text, m.odds)
                rise, found, total, spans = _examine(scores, rows, m.law)
                n_words = np.diff(rows)
                p = probability(_inputs(n_words, rise, found, total, m.law), m.weights)
                data, offsets = utf8(text)
                points = np.concatenate([[0], np.cumsum(~CONTINUATION[data], dtype=np.int64)])
                passages = [
                    [{"start": int(points[begin[rows[r] + a]] - points[offsets[r]]), "end": int(points[end[rows[r] + b - 1]] - points[offsets[r]]), "evidence": float(m.law.evidence(np.array([s]), n_words[r : r + 1])[0])} for a, b, s in found_in]
                    for r, found_in in enumerate(spans)
                ]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), column(part, "held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(passages, pa.list_(_PASSAGE))],
                    names=["doc_id", "held_out", "score", "predicted", "passages"],
                )

    return rows_of.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, passages array<struct<start:bigint,end:bigint,evidence:double>>")


def _fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~_fold("doc_id")))
    scored = score(docs, model, _fold("doc_id"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def queries() -> dict:
    return {"op13_toxicity": op13_toxicity}
