"""Operators against plain loops over small tables."""

import bisect
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buildlens.llm import decontaminate, pii, quality_gam
from test_dedup import plain_alignment


def edited(rng, words, rate):
    """Words with so many of them replaced, dropped or preceded by another."""
    out = []
    for w in words:
        if rng.random() >= rate:
            out.append(w)
            continue
        kind = rng.randrange(3)
        out += [] if kind == 0 else [f"n{rng.randrange(10**6)}"] + [w] * (kind - 1)
    return out


def test_contaminated_against_all_alignments(spark):
    """Every row that is found is right, and the seeds lose hardly any that an alignment of all pairs finds."""
    rng = random.Random(31)
    vocabulary = [f"v{k}" for k in range(400)]
    common = [f"c{k}" for k in range(12)]  # half of all words: n-grams of these seed nothing rare
    make = lambda n: [rng.choice(common if rng.random() < 0.5 else vocabulary) for _ in range(n)]
    items = [make(rng.randint(15, 60)) for _ in range(12)]
    texts = [make(rng.randint(20, 120)) for _ in range(30)]
    for rate in (0.0, 0.05, 0.1, 0.15, 0.2, 0.25):
        for item in items:
            texts.append(make(rng.randint(0, 40)) + edited(rng, item, rate) + make(rng.randint(0, 40)))
    want = {}
    for (d, text), (i, item) in itertools.product(enumerate(texts), enumerate(items)):
        best = plain_alignment(item, text)
        if best >= 2 * decontaminate.ENOUGH or best >= 2 * len(item) * decontaminate.THRESHOLD:
            want[d, i] = best / (2 * len(item))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) <= set(want) and all(s <= want[k] + 1e-9 for k, s in got.items())
    planted = {k for k in want if k[0] >= 30}
    assert len(planted) >= 60 and len(set(got) & planted) >= 0.97 * len(planted)
    assert sum(math.isclose(got[k], want[k]) for k in got) >= 0.97 * len(got)


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_matches_whatever_pairs_are_laid_out_at_once(monkeypatch, at_once):
    rng = random.Random(8)
    texts = pa.array([" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 2, 40, 300)])
    items = pa.array([" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (12, 12, 30, 150)])
    block = decontaminate.Block.of(items)
    whole = decontaminate.matches(texts, block, block.bitmap())
    monkeypatch.setattr(decontaminate, "PAIRS_AT_ONCE", at_once)
    part = decontaminate.matches(texts, block, block.bitmap())
    assert len(whole["row"]) and all(np.array_equal(whole[k], part[k]) for k in whole)


def plain_score(model, x):
    """One row, table by table."""
    bins = [bisect.bisect_right(list(edges), v) for edges, v in zip(model.edges, x)]
    total = model.base
    for table, b in zip(model.main, bins):
        total += table[b]
    for i, j, table in model.pairs:
        total += table[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]]
    return 1 / (1 + math.exp(-total))


def test_scores_against_a_walk_of_the_tables(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality_gam.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    got = {r["doc_id"]: r["score"] for r in quality_gam.op3_quality_gam(spark, small).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and len(model.pairs) == quality_gam.PAIRS
    for r in rows:
        alone = quality_gam.features(pa.array([r["text"]], pa.string()))[0]
        assert got[r["doc_id"]] == pytest.approx(plain_score(model, alone), abs=1e-9)


def leaf(g, h):
    return -sum(g) / (sum(h) + quality_gam.RIDGE)


def gain(g, h):
    return sum(g) ** 2 / (sum(h) + quality_gam.RIDGE)


def test_trees_against_a_search_of_all_cuts():
    """The first cut is the best of all, the second the best of all that are left."""
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(2, 12)
        g, h = [rng.gauss(0, 3) for _ in range(n)], [rng.random() + 0.01 for _ in range(n)]

        def total(cuts):
            return sum(gain(g[a:b], h[a:b]) for a, b in zip([0, *cuts], [*cuts, n]))

        cuts = [max(range(1, n), key=lambda c: total([c]))]
        more = [sorted([*cuts, c]) for c in range(1, n) if c not in cuts]
        best = max(more, key=total, default=cuts)
        cuts = best if total(best) > total(cuts) else cuts
        want = [v for a, b in zip([0, *cuts], [*cuts, n]) for v in [leaf(g[a:b], h[a:b])] * (b - a)]
        assert quality_gam._tree(np.array(g), np.array(h)) == pytest.approx(want)


def test_a_pair_of_features_is_learnt():
    """Labels that only two features together tell; one of them alone tells nothing."""
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert np.mean((model.probability(x) > 0.5) == y) > 0.85 and {(i, j) for i, j, _ in model.pairs} >= {(1, 0)}


def test_chosen_spans_against_all_pairs(monkeypatch):
    """Candidates by falling probability, none that overlaps one chosen before; many in a text."""
    rng = random.Random(12)
    detector = pii.trained()
    found = []
    for _ in range(1500):
        a = rng.randrange(6000)
        found.append((a, a + rng.randint(1, 12), rng.choice(pii.KINDS)))
    p = np.round(np.array([rng.random() for _ in found]), 2)  # with ties
    monkeypatch.setattr(pii, "base_spans", lambda text: [])
    monkeypatch.setattr(pii, "candidates", lambda text, base: found)
    monkeypatch.setattr(pii, "describe", lambda text, c: [0.0])
    monkeypatch.setattr(pii.Detector, "probability", lambda self, x, kinds: p)
    chosen = []
    for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i][0], pii.KINDS.index(found[i][2]))):
        a, b, kind = found[i]
        if p[i] >= detector.threshold[pii.KINDS.index(kind)] and all(b <= c or a >= d for c, d, _ in chosen):
            chosen.append(found[i])
    got = detector.spans("x")[1]
    assert len(got) > 100 and got == sorted(chosen, key=lambda s: (s[0], pii.KINDS.index(s[2])))
