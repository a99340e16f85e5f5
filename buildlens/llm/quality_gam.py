"""Document quality by a generalised additive model with pairwise interactions.

Every feature is binned; a term is a lookup table over the bins of one feature or of a
pair.  Boosting goes round the features, fits a tree of at most three leaves to the
gradients of one feature and adds a small step of it to that feature's table; then the
strongest pairs are boosted in the same way.  A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import bound_batches, column, slices, table
from buildlens.llm.textstats import measure

FEATURES = ["symbol", "pipe", "bang", "upper", "digit", "letter", "log_words", "word_bytes", "longest", "repeat", "again", "no_letter", "dup_lines", "line_words", "non_ascii"]
#: Labelled rows that the model is fitted on at most (the least hashes of their ids).
SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 60
PAIR_ROUNDS = 30
PAIRS = 8
RATE = 0.15
RIDGE = 2.0
THRESHOLD = 0.3


def features(arr: pa.Array) -> np.ndarray:
    s = measure(arr).shares
    return np.stack([s[k].astype(np.float64) for k in FEATURES], axis=1)


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float = 0.0
    main: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.main:
            return out
        b = self.bins(x)
        for j, t in enumerate(self.main):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with at most two cuts."""
    cg, ch = np.cumsum(g), np.cumsum(h)

    def cut(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, -1
        g0, h0 = (cg[lo - 1], ch[lo - 1]) if lo else (0.0, 0.0)
        gl, hl = cg[lo : hi - 1] - g0, ch[lo : hi - 1] - h0
        gt, ht = cg[hi - 1] - g0, ch[hi - 1] - h0
        score = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
        k = int(score.argmax())
        return float(score[k]), lo + k + 1

    n = len(g)
    _, c = cut(0, n)
    cuts = [0, n] if c < 0 else [0, c, n]
    if c > 0:
        left, right = cut(0, c), cut(c, n)
        best = max(left, right)
        if best[0] > 0:
            cuts = sorted({*cuts, best[1]})
    out = np.zeros(n)
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit to rows of features and labels 0/1; one class only gives its smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Model([], base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # Rare values matter as much as quantiles: half of the cuts lie evenly between the extremes.
    edges = [np.unique(np.concatenate([e, np.linspace(x[:, j].min(), x[:, j].max(), BINS // 2 + 2)[1:-1]])) for j, e in enumerate(edges)]
    m = Model(edges, base, [np.zeros(len(e) + 1) for e in edges])
    b = m.bins(x)
    raw = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j in range(x.shape[1]):
            p = 1 / (1 + np.exp(-raw))
            n = len(m.main[j])
            step = RATE * _tree(np.bincount(b[:, j], p - y, n), np.bincount(b[:, j], p * (1 - p), n))
            m.main[j] += step
            raw += step[b[:, j]]
    m.coarse = [np.minimum(np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1), PAIR_BINS - 1) for e in edges]
    c = np.stack([m.coarse[j][b[:, j]] for j in range(x.shape[1])], axis=1)
    p = 1 / (1 + np.exp(-raw))
    cells = PAIR_BINS * PAIR_BINS

    def cell_gain(i: int, j: int) -> float:
        at = c[:, i] * PAIR_BINS + c[:, j]
        return float(_gain(np.bincount(at, p - y, cells), np.bincount(at, p * (1 - p), cells)).sum())

    ranked = sorted(((cell_gain(i, j), i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:PAIRS]
    tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in ranked]
    for _ in range(PAIR_ROUNDS):
        for t, (_, i, j) in zip(tables, ranked):
            p = 1 / (1 + np.exp(-raw))
            at = c[:, i] * PAIR_BINS + c[:, j]
            g, h = (np.bincount(at, v, cells).reshape(PAIR_BINS, PAIR_BINS) for v in (p - y, p * (1 - p)))
            step = np.zeros_like(t)
            # one cut along the first feature, and on either side one along the second
            k = int(np.argmax([_gain(g[:q].sum(0), h[:q].sum(0)).sum() + _gain(g[q:].sum(0), h[q:].sum(0)).sum() for q in range(1, PAIR_BINS)])) + 1
            step[:k] = _tree(g[:k].sum(0), h[:k].sum(0))
            step[k:] = _tree(g[k:].sum(0), h[k:].sum(0))
            t += RATE * step
            raw += RATE * step[c[:, i], c[:, j]]
    m.pairs = [(i, j, t) for t, (_, i, j) in zip(tables, ranked)]
    return m


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(label, text) of at most `sample` labelled documents: those with the least hashes of their ids.

    Labels that repeat an id count once, as the greatest; null labels and ids are left out.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("__id"), F.col(label).cast("int").alias("label")).where("__id is not null and label is not null")
    known = known.groupBy("__id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("text").cast("string").alias("__text"))
    return texts.join(F.broadcast(known), "__id").select("label", "__text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of at most `sample` labelled documents, the same whatever their partitions.

    Null texts count as empty ones.  Without labels, or with one class only, the model is
    the smoothed share of label 1 for every text.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                x = features(column(part, "__text"))
                yield pa.RecordBatch.from_arrays([column(part, "label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["label", "x"])

    got = labelled(docs, labels, label, sample).mapInArrow(run, "label int, x array<double>").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = (got["label"].to_numpy() > 0).astype(np.float64)
    order = np.lexsort((*x.T, y)) if len(y) else slice(None)  # the same fit whatever the partitions
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts are scored as empty ones, texts of any length whole; a score equal to the
    threshold predicts 1.  Equal texts get equal scores, repeated rows repeated results; a
    null `held_out` is false, a null doc_id stays null.  An empty table gives an empty one;
    columns other than doc_id, text and what `held_out` names are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                p = model.probability(features(column(part, "__text")))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def _fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~_fold("doc_id")))
    return score(docs, model, _fold("doc_id"))


def queries() -> dict:
    return {"op3_quality_gam": op3_quality_gam}
