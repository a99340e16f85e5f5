"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Lines with a word are a sequence; Viterbi decoding finds the likeliest labels, and a
document is kept if content lines hold enough of its words.  The field is trained here.
Labels are of documents, states of lines, so it learns from two kinds of sequences: whole
labelled documents, and pages spliced of runs of lines of good and of bad documents, in
which states change.  A second fit lets the first one correct lines of bad documents that
look like content: a bad document needs no bad line everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from buildlens.llm.common import bound_batches, column, slices, table
from buildlens.llm.quality_gam import labelled
from buildlens.llm.textops import segment_reduce
from buildlens.llm.textstats import Stats, measure

#: Labelled documents that the field is fitted on at most; all their lines count, in windows of WINDOW.
SAMPLE = 4_000
WINDOW = 48
RUN = 6  # lines of a run in a spliced page on average
SURE = 0.9  # probability of content at which a line of a bad document is taken for content
STEPS = 120
SHARE = 0.5  # of words in content lines, for a document to be kept
MIN_WORDS = 50
MAX_REPEAT = 50  # percent of words in repeated 3-word windows


def line_features(s: Stats) -> np.ndarray:
    """Indicator features of all lines of a batch."""
    v = s.lines
    cols = [np.ones(len(v["words"]))]
    cols += [v["words"] <= 2, (v["words"] > 2) & (v["words"] < 8), v["words"] >= 40]
    cols += [v[k] > t for k, t in (("symbol", 0.02), ("symbol", 0.1), ("pipe", 0.05), ("bang", 0.05), ("upper", 0.3), ("upper", 0.6), ("digit", 0.1), ("repeat", 0.2), ("repeat", 0.6), ("word_bytes", 12.0))]
    cols += [v["dup"], v["stop"], v["letter"] < 0.5]
    return np.stack([np.asarray(c, dtype=np.float64) for c in cols], axis=1)


@dataclass
class Field:
    """States: 0 boilerplate, 1 content."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def viterbi(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Likeliest states of all sequences, stepwise over those that are still running; ties go to content."""
        e = x @ self.emit
        out = np.ones(len(x), dtype=np.int8)
        size = np.diff(rows)
        order = np.argsort(-size, kind="stable")
        base, size = rows[:-1][order], size[order]
        live = int((size > 0).sum())
        if not live:
            return out
        best = self.start + e[base[:live]]
        back = np.zeros((len(x), 2), dtype=np.int8)
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))
            prev = best[:live, :, None] + self.move[None]
            one = prev[:, 1] >= prev[:, 0]
            back[base[:live] + t] = one
            best[:live] = np.where(one, prev[:, 1], prev[:, 0]) + e[base[:live] + t]
        live = int((size > 0).sum())
        state = (best[:live, 1] >= best[:live, 0]).astype(np.int8)
        last = base[:live] + size[:live] - 1
        out[last] = state
        for t in range(int(size[0]) - 1, 0, -1):
            n = int(np.searchsorted(-size, -t, side="left"))
            at = base[:n] + t
            out[at - 1] = back[at, out[at]]
        return out


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Sequences:
    """Windows of about equal length: features, presence, states, whether a text begins there, weight."""

    x: np.ndarray
    mask: np.ndarray
    y: np.ndarray
    first: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(lines: list[np.ndarray], states: list[np.ndarray], first: list[bool], weight: list[float]) -> list[Sequences]:
        """Padded by lengths of 4, 8, 16 ... so that short texts cost little."""
        size = np.array([len(v) for v in lines], dtype=np.int64)
        out, low, width = [], 0, 4
        while low < (size.max() if len(size) else 0):
            some = np.flatnonzero((size > low) & (size <= width))
            if len(some):
                x = np.zeros((len(some), width, lines[0].shape[1]))
                mask, y = np.zeros((len(some), width)), np.zeros((len(some), width), np.int64)
                for k, i in enumerate(some.tolist()):
                    x[k, : size[i]], mask[k, : size[i]], y[k, : size[i]] = lines[i], 1, states[i]
                out.append(Sequences(x, mask, y, np.array(first, dtype=np.float64)[some], np.array(weight)[some]))
            low, width = width, 2 * width
        return out


def _posterior(field: Field, s: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of states and of neighbouring pairs, by the forward and backward sums."""
    n, width, _ = s.x.shape
    both = s.mask[:, 1:] * s.mask[:, :-1]
    e = s.x @ field.emit
    alpha, beta = np.empty((n, width, 2)), np.zeros((n, width, 2))
    alpha[:, 0] = s.first[:, None] * field.start + e[:, 0]
    for t in range(1, width):
        a = _logsum(alpha[:, t - 1, :, None] + field.move, 1) + e[:, t]
        alpha[:, t] = np.where(s.mask[:, t, None] > 0, a, alpha[:, t - 1])
    for t in range(width - 2, -1, -1):
        b = _logsum(field.move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(s.mask[:, t + 1, None] > 0, b, 0.0)
    z = _logsum(alpha[:, -1], 1)
    node = np.exp(alpha + beta - z[:, None, None]) * s.mask[:, :, None]
    pair = np.exp(alpha[:, :-1, :, None] + field.move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
    return node, pair


def fit(batches: list[Sequences], steps: int = STEPS, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps (Adam); without lines of both states all is content."""
    seen = {int(v) for s in batches for v in np.unique(s.y[s.mask > 0])}
    if len(seen) < 2:
        f = batches[0].x.shape[2] if batches else len(line_features(measure(pa.array(["a"])))[0])
        return Field(np.stack([np.zeros(f), np.eye(f)[0]], axis=1), np.zeros((2, 2)), np.zeros(2))
    f = batches[0].x.shape[2]
    theta = np.zeros(2 * f + 6)
    total = sum(float((s.mask * s.weight[:, None]).sum()) for s in batches)
    gold = []
    for s in batches:
        node = np.stack([(s.y == k) * s.mask for k in (0, 1)], axis=2)
        pair = node[:, :-1, :, None] * node[:, 1:, None, :]
        gold.append((node, np.einsum("ntij,n->ij", pair, s.weight), np.einsum("nk,n->k", node[:, 0], s.weight * s.first)))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    unpack = lambda v: Field(v[: 2 * f].reshape(f, 2), v[2 * f : 2 * f + 4].reshape(2, 2), v[2 * f + 4 :])
    for step in range(1, steps + 1):
        grad_e, grad_m, grad_s = np.zeros((f, 2)), np.zeros((2, 2)), np.zeros(2)
        for s, (node0, pair0, start0) in zip(batches, gold):
            node, pair = _posterior(unpack(theta), s)
            off = ((node0 - node) * s.weight[:, None, None]).reshape(-1, 2)
            grad_e += s.x.reshape(-1, f).T @ off
            grad_m += pair0 - np.einsum("ntij,n->ij", pair, s.weight)
            grad_s += start0 - np.einsum("nk,n->k", node[:, 0], s.weight * s.first)
        grad = np.concatenate([grad_e.ravel(), grad_m.ravel(), grad_s]) / total - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta = theta + 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return unpack(theta)


def spliced(texts: list[list[np.ndarray]], n: int, rng: np.random.Generator) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(lines, states) of n pages: runs of lines of bad (texts[0]) and good documents (texts[1]) in turn."""
    lines, states = [], []
    for _ in range(n):
        state, x, y = int(rng.integers(2)), [], []
        for _ in range(int(rng.integers(2, 6))):
            of = texts[state][int(rng.integers(len(texts[state])))]
            at = int(rng.integers(len(of)))
            run = of[at : at + int(rng.geometric(1 / RUN))]
            x.append(run)
            y.append(np.full(len(run), state))
            state = 1 - state
        lines.append(np.concatenate(x)[:WINDOW])
        states.append(np.concatenate(y)[:WINDOW])
    return lines, states


def learn(texts: list[list[np.ndarray]], steps: int = STEPS, seed: int = 5) -> Field:
    """The field of line features of bad (texts[0]) and good documents (texts[1])."""
    if not texts[0] or not texts[1]:
        one = [v[:WINDOW] for v in texts[0] + texts[1]]
        return fit(Sequences.of(one, [np.ones(len(v), np.int64) for v in one], [True] * len(one), [1.0] * len(one)), steps)
    rng = np.random.default_rng(seed)
    total = len(texts[0]) + len(texts[1])
    cut = [[(v[a : a + WINDOW], a == 0) for v in group for a in range(0, len(v), WINDOW)] for group in texts]
    mixed, mixed_y = spliced(texts, total // 2, rng)
    lines = [v for group in cut for v, _ in group] + mixed
    first = [b for group in cut for _, b in group] + [True] * len(mixed)
    weight = [0.5 * total / len(group) for group in cut for _ in group] + [1.0] * len(mixed)  # both labels count alike
    states = [np.full(len(v), k) for k, group in enumerate(cut) for v, _ in group] + mixed_y
    field = fit(Sequences.of(lines, states, first, weight), steps // 2)
    # lines of bad documents that the first field takes for content, alone and so without their neighbours' say
    alone = lambda v: _sigmoid(v @ (field.emit[:, 1] - field.emit[:, 0]))
    states = [np.where((y == 0) & (alone(v) > SURE), 1, y) for v, y in zip(lines, states)]
    return fit(Sequences.of(lines, states, first, weight), steps)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most `sample` labelled documents; only their line features reach the driver.

    Without labels of both kinds, or an empty table, all lines are content.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                s = measure(column(part, "__text"))
                x, y = line_features(s), column(part, "label").to_numpy()
                some = np.flatnonzero(np.diff(s.line_rows) > 0)
                cells = [x[s.line_rows[i] : s.line_rows[i + 1]].astype(np.uint8).tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(y[some], pa.int32()), pa.array(cells, pa.binary())], names=["label", "x"])

    got = labelled(docs, labels, "quality", sample).mapInArrow(run, "label int, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], r["x"]))
    f = line_features(measure(pa.array([""]))).shape[1]
    texts: list[list[np.ndarray]] = [[], []]
    for r in got:
        texts[int(r["label"] > 0)].append(np.frombuffer(r["x"], np.uint8).reshape(-1, f).astype(np.float64))
    return learn(texts)


def judge(texts: pa.Array, field: Field, share: float = SHARE) -> dict[str, np.ndarray]:
    """Counts and verdicts of a batch."""
    s = measure(texts)
    state = field.viterbi(line_features(s), s.line_rows) if len(s.lines["words"]) else np.zeros(0, np.int8)
    content = segment_reduce(np.add, s.lines["words"] * state, s.line_rows)
    failed = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MAX_REPEAT * s.n_words)
    held = content / np.maximum(s.n_words, 1)
    return {
        "n_words": s.n_words, "word_chars": s.word_chars, "n_symbols": s.n_symbols, "n_dup_lines": s.n_dup_lines, "n_repeat_words": s.n_repeat_words,
        "base_failed": failed, "kept": ~failed & (held >= share), "n_lines": np.diff(s.line_rows), "content_share": held,
    }


def quality_rules(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """Counts, base rule and verdict of every row.

    Null and empty texts have no words and fail the base rule.  Rows that repeat are
    judged alike, also those that repeat an id with another text; ties of states go to
    content; a text of any length is one sequence; an empty table gives an empty one.
    Columns other than doc_id and text are not read.
    """
    bound_batches(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) __text")
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_lines bigint, content_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                got = judge(column(part, "__text"), field, share)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *map(pa.array, got.values())], names=["doc_id", *got])

    return docs.mapInArrow(run, schema)


def keep_quality(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """The rows of `docs` that quality_rules keeps, all columns as they are."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(judge(column(part, "text"), field, share)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {"op5_line_crf": op5_line_crf}
