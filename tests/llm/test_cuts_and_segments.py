"""Delta Lloyd, fill-in-the-middle and toxic segments, against plain versions."""

import glob
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from buildlens.llm import delta_lloyd, fill_middle, toxicity

DOC = "doc_id bigint, text string, form string"


@pytest.mark.parametrize("module", [delta_lloyd, fill_middle])
def test_against_sql(spark, small, module):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    (name, query), sql = next(iter(module.queries().items())), next(iter(module.oracle_sql().values()))
    got, want = query(spark, small), c.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    rows = {tuple(r[x] for x in want.columns) for r in got.collect()}
    assert rows == {tuple(r) for r in want.fetchall()} and len(rows) == got.count()


# --- op11 ---


def plain_lloyd(rows, k, rounds, dim, seed=2):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes().hex()))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        owner = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, owner) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), centroids


@pytest.mark.parametrize("seed", range(3))
def test_delta_rounds_equal_plain_ones(spark, seed):
    r = random.Random(seed)
    rows = [(i % 90, [r.randrange(-4, 5) / 256 for _ in range(3)]) for i in range(120)]  # many ties, repeated ids
    rows += [rows[0]] * 20 + [(None, [0.5, 0.25, 1.0]), (500, None), (501, [1.0, None, 2.0]), (502, [1.0, float("nan"), 2.0]), (503, [1.0, float("inf"), 0.0]), (504, [1.0, 2.0]), (505, [])]
    frame = spark.createDataFrame([(i, v, -1, 0) for i, v in rows], "vec_id bigint, embedding array<float>, cluster int, distance int")
    got, centroids = delta_lloyd.cluster(frame, clusters=7, rounds=4, dim=3)
    want, plain = plain_lloyd(rows, 7, 4, 3)
    assert sorted((tuple(x) for x in got.select("vec_id", "cluster", "distance").collect()), key=str) == want
    assert centroids.tolist() == plain


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id bigint, embedding array<float>")
    got, centroids = delta_lloyd.cluster(frame, clusters=5, rounds=3, dim=2)
    assert sorted(r["distance"] for r in got.collect()) == [0, 0] and len(centroids) == 2
    got, centroids = delta_lloyd.cluster(frame.limit(0), dim=2)
    assert got.count() == 0 and len(centroids) == 0


def test_only_moved_centroids_are_compared(monkeypatch):
    r = np.random.default_rng(0)
    x, c = r.integers(-50, 50, (200, 4)), r.integers(-50, 50, (9, 4))
    owner, far = delta_lloyd.reassign(x, np.full(200, -1), np.zeros(200, np.int64), c, np.arange(9))
    new = c.copy()
    new[[2, 5]] += 7
    asked = []
    plain = delta_lloyd.distances
    monkeypatch.setattr(delta_lloyd, "distances", lambda a, b: asked.append(len(a) * len(b)) or plain(a, b))
    got = delta_lloyd.reassign(x, owner, far, new, np.array([2, 5]))
    lost = int(np.isin(owner, [2, 5]).sum())
    assert sum(asked) == lost * 9 + (200 - lost) * 2
    d = plain(x, new)
    assert (got[0] == d.argmin(1)).all() and (got[1] == d.min(1)).all()


@pytest.mark.parametrize("size", [1, 1 << 23, delta_lloyd.LARGEST])
def test_distances_are_exact(size):
    r = np.random.default_rng(size)
    x, c = r.integers(-size, size + 1, (20, 64)), r.integers(-size, size + 1, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]
    assert delta_lloyd.distances(x, c).tolist() == want


# --- op12 ---

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text):
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    u = UNIT.findall(text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab<PSM> \t\né€\U0001f600\u0085 ", max_size=30), max_size=12))
def test_kernel_equals_regular_expression(texts):
    ids = list(range(len(texts)))
    h = np.array([[int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for i in ids], np.int64).reshape(-1, 4)
    got = fill_middle.rearrange(pa.array(texts, pa.string()), h)
    columns = [got[k].tolist() if isinstance(got[k], np.ndarray) else got[k].to_pylist() for k in ("n", "form", "prefix_chars", "middle_chars", "output")]
    assert list(zip(*columns)) == [plain_middle(i, t) for i, t in zip(ids, texts)]


def test_middle_edges_and_restoring(spark):
    r = random.Random(3)
    texts = [None, "", " ", "\n\t ", "a", "x <P> y", "a<", "<S", "é " * 40_000, "z" * 300_000] + ["".join(r.choice("ab <SPM>\né") for _ in range(r.randrange(40))) for _ in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c d", "x"), (3, "\n\t ", "x")]
    frame = spark.createDataFrame(rows, DOC)
    made = fill_middle.fill_middle(frame)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    assert sorted((tuple(x)[:6] for x in got), key=str) == sorted(((i, *plain_middle(i, t)) for i, t, _ in rows), key=str)
    back = {x["doc_id"]: x["back"] for x in got}
    assert all(back[i] == (t or "") for i, t, _ in rows)
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(frame.limit(0)).count() == 0


# --- op13 ---


def plain_segments(scores, lo=0):
    """The highest segment (of equal ones the shortest, then the first), and the same left and right of it."""
    best = max(((sum(scores[a:b]), a - b, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return plain_segments(scores[:a], lo) + [(lo + a, lo + b, best[0])] + plain_segments(scores[b:], lo + b)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(-5, 5).filter(bool), max_size=14))
def test_segments_are_the_recursive_ones(scores):
    got = toxicity.segments(np.array(scores, np.int64))
    assert sorted(s for *_, s in got) == sorted(s for *_, s in plain_segments(scores))
    assert all(sum(scores[a:b]) == s for a, b, s in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert toxicity.best_rise(np.array(scores, np.int64), np.array([0, len(scores)])).tolist() == [max((s for *_, s in got), default=0)]


def test_best_rise_keeps_to_its_row():
    scores, rows = np.array([5, -1, 5, -9, 7, 7, -3]), np.array([0, 0, 3, 4, 5, 7, 7])
    assert toxicity.best_rise(scores, rows).tolist() == [0, 9, 0, 7, 7, 0]


def test_law_is_found_again():
    r = np.random.default_rng(1)
    n = r.integers(50, 2000, 20_000)
    rate, k = 0.02, 0.3
    s = np.log(k * n / r.exponential(size=len(n))) / rate
    law = toxicity.fit_law(s, n)
    assert abs(law.rate / rate - 1) < 0.03 and abs(law.k / k - 1) < 0.1
    assert toxicity.fit_law(np.zeros(9, np.int64), np.full(9, 50)) == toxicity.Law(1 / toxicity.UNIT, 1 / 50)


def test_words_are_folded_to_their_letters():
    data, begin, end, rows = toxicity.words_of(pa.array(["The 'CÔTÉ!! 12", None, "Été, ### a-b"]))
    assert [bytes(data[a:b]).decode() for a, b in zip(begin, end)] == ["the", "côté", "12", "été", "###", "a-b"] and rows.tolist() == [0, 3, 3, 6]


def test_unseen_words_lean_on_their_stems():
    clean, toxic = "gabel gabun haus laufen", "gemeinheit gemeines"
    text = pa.array([clean, toxic])
    data, begin, end, rows = toxicity.words_of(text)
    keys, kind = toxicity.stems(data, begin, end), np.repeat([0, 1], np.diff(rows))
    known = np.unique(keys[keys > 0])
    n = [np.array([(keys[kind == c] == k).sum() for k in known]) for c in (0, 1)]
    odds = toxicity.Odds(known, n[0], n[1], 0.5)
    s, *_ = toxicity.token_scores(pa.array(["gemeine gabeln fremd gemeinheit gem"]), odds)
    drift = round(toxicity.UNIT * toxicity.DRIFT)
    assert s[0] > -drift > s[1] and s[2] == -drift and s[4] == round(toxicity.UNIT * (np.log((2 + 1.5) / 1.5) - toxicity.DRIFT))


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghi") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randrange(20, 200))]
        bad = i % 4 == 0
        if bad:
            at = r.randrange(len(text) - 8)
            for k in range(3):
                text[at + 2 * k] = "zonk" + r.choice(["", "er", "ing"])
        elif i % 4 == 1:
            text[5] = "zonk"  # one such word alone is no passage
        out.append((i, " ".join(text), bad))
    return out


def test_toxic_passages_are_found(spark):
    rows = corpus(600, 5)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows if i < 400] + [(3, None), (None, 1), (4, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(7), labels)
    assert model.law == again.law and np.allclose(model.weights, again.weights) and (model.odds.n1 == again.odds.n1).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, F.col("doc_id") >= 400).collect()}
    late = [(got[i], t, b) for i, t, b in rows if i >= 400]
    assert sum(g["predicted"] == b for g, _, b in late) >= 0.97 * len(late) and all(g["held_out"] for g, *_ in late)
    for g, t, b in late:
        if b and g["predicted"]:
            assert any("zonk" in t[p["start"] : p["end"]] and t[p["start"] : p["end"]].startswith("zonk") for p in g["passages"])


def test_toxicity_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (None, "zonk zonk zonk", "x"), (5, "zonk " * 100_000, "x"), (6, "a b", "x"), (6, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, passages string")
    for labels in ([], [(6, 0)], [(5, 1), (6, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        got = toxicity.score(docs, model, F.lit(None).cast("boolean")).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] is False for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 6}) == 1
    assert toxicity.score(docs.limit(0), model, F.lit(True)).count() == 0


def test_toxicity_on_held_out_documents(spark, small):
    big = small.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.queries()["op13_toxicity"](spark, big).where("held_out").join(labels, "doc_id")
    n, hit, found, toxic = got.agg(F.count("*"), F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert n > 700 and hit >= 0.9 * toxic and hit >= 0.9 * found
