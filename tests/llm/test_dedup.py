import random

import numpy as np
import pyarrow as pa
import pytest

from buildlens.llm import hyperminhash as hmh
from buildlens.llm.components import connected_components
from buildlens.llm.decontaminate import contaminated, drop_contaminated, local_alignment
from buildlens.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from buildlens.llm.substring_dedup import drop_repeated, equal_stretches, paragraphs, repeated_passages

SPACES = " \t\n\x0b\x0c\r"
DOC = "doc_id bigint, text string"


def words(text):
    out, cur = [], ""
    for c in text or "":
        if c in SPACES:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + [cur] * bool(cur)


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(items):
    """Least key by component of {key: set}, linking at 0.75."""
    keys = sorted(items)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = items[a], items[b]
            if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 75 * (len(x) + len(y) - n):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def corpus(seed, groups=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            edit = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                edit[rng.randrange(len(edit))] = rng.choice(vocabulary)
            texts.append(" ".join(edit))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_brute_force(spark):
    rows = [*corpus(1), (9001, None), (9002, ""), (9003, " \n "), (9004, "One two"), (9005, "oNE\ttwo"), (9006, "x " * 20_000), (9007, "X " * 30_000)]
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    sets = {k: shingles(t) for k, t in rows}
    want = brute_components(sets)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert all(r["kept"] == (want[k] == k) for k, r in got.items())


def test_near_duplicates_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute_components({r["doc_id"]: shingles(r["text"]) for r in docs.collect()})
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == want


def test_large_group_and_ties(spark):
    rng = random.Random(4)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(3000):
        edit = list(base)
        edit[rng.randrange(60)] = f"z{rng.randrange(50)}"
        rows.append((k, " ".join(edit)))
    got = near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_drop_near_duplicates_edges(spark):
    t = "a b c d e f g h"
    rows = [(1, t, "k"), (1, t, "k"), (1, "quite another text of some words", "k"), (2, t.upper(), "k"), (None, "nothing like it at all here", "k"), (3, None, "k"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    out = sorted(((r["doc_id"], r["text"]) for r in drop_near_duplicates(docs).collect()), key=str)
    assert out == sorted([(1, t), (1, rows[2][1]), (None, rows[4][1]), (3, None), (4, "")], key=str)
    assert drop_near_duplicates(docs).columns == docs.columns
    assert drop_near_duplicates(docs.limit(0)).count() == 0 and near_duplicates(docs.limit(0)).count() == 0


def test_drop_near_duplicates_with_repeated_and_null_ids(spark):
    t = " ".join(f"m{k}" for k in range(40))
    near, other = t + " tail", " ".join(f"o{k}" for k in range(30))
    rows = [(5, t), (5, near), (7, t.upper()), (7, other), (None, near.upper()), (None, "alone with its own words here"), (None, "alone with its own words here"), (None, None), (2**63 - 1, "last of all ids"), (None, "last of all ids now")]
    docs = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], DOC + ", row int, member string, __doc string")
    out = [(r["doc_id"], r["text"]) for r in drop_near_duplicates(docs).collect()]
    copies = [r for r in out if r in rows[:3] + rows[4:5]]
    assert len(copies) == 1 and copies[0][0] == 5
    assert sorted((r for r in out if r not in copies), key=str) == sorted([rows[3], rows[5], rows[7], rows[8], rows[9]], key=str)
    assert drop_near_duplicates(docs).columns == docs.columns


def test_hyperminhash_estimates():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    for share in (0.3, 0.75, 0.95):
        keep = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:keep], rng.integers(0, 2**63, len(a) - keep, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = hmh.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), hmh.Banding(1, 256, 0.0))
        assert abs(hmh.estimate(sig[0], sig[1], len(a), len(b)) - true) < 0.12
    least = np.array([1, 2, 3, 2**63, 2**64 - 1, 2**40 + 5], dtype=np.uint64)
    assert [int(x) >> 10 for x in hmh.compress(least)] == [64 - int(v).bit_length() for v in least.tolist()]


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (7, 3), (3, 7), (None, 2)]
    got = {r["id"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {5: 5, 7: 3, 3: 3}


def test_repeated_passages(spark):
    rng = random.Random(8)
    vocabulary = [f"q{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    near = passage.split()
    near[7] = "other"
    rows = [(k, f"{text(40)}\n{passage if k % 3 else ' '.join(near)}\n{text(30)}\nshort line") for k in range(30)] + [(50, None), (51, ""), (52, "\n\n"), (53, f"{passage}\n{passage}")]
    docs = spark.createDataFrame(rows, DOC)
    sets = {(r["doc_id"], r["paragraph"]): shingles(r["text"]) for r in paragraphs(docs).collect()}
    assert set(sets) == {(k, i) for k, t in rows if t for i, line in enumerate(t.split("\n")) if len(words(line)) >= 20}
    comp = brute_components(sets)
    sizes = {c: sum(v == c for v in comp.values()) for c in comp.values()}
    got = {(r["doc_id"], r["paragraph"]): ((r["cluster_doc_id"], r["cluster_paragraph"]), r["removed"]) for r in repeated_passages(docs).collect()}
    assert got == {k: (c, c != k) for k, c in comp.items() if sizes[c] > 1}
    out = {r["doc_id"]: r["text"] for r in drop_repeated(docs.selectExpr("doc_id", "text", "1 as removed")).collect()}
    assert out[1] == "\n".join(x for i, x in enumerate(rows[1][1].split("\n")) if i != 1) and out[0] == rows[0][1] and out[50] is None and out[53] == ""
    assert repeated_passages(docs.limit(0)).count() == 0


def test_repeated_runs_beyond_lines(spark):
    """A run inside longer lines, one over short lines, and one twice in a text of its own id."""
    rng = random.Random(18)
    fresh = iter(range(10**6))
    text = lambda n: [f"r{next(fresh)}x{rng.randrange(99)}" for _ in range(n)]
    inside, across = text(60), text(55)
    short = "\n".join(" ".join(across[i : i + 5]) for i in range(0, 55, 5))
    rows = [
        (1, " ".join(text(80) + inside + text(30))), (2, " ".join(text(30) + inside + text(90)).upper()), (3, " ".join(text(40) + across + text(40))), (4, " ".join(text(9)) + "\n" + short + "\n" + " ".join(text(9))),
        (5, " ".join(text(200))), (6, "é " * 100), (7, "é " * 300), (8, None), (4, " ".join(text(70))),
    ]
    docs = spark.createDataFrame(rows, DOC)
    got = [r for r in repeated_passages(docs).collect() if r["doc_id"] < 6]
    assert sorted((r["doc_id"], r["cluster_doc_id"], r["removed"]) for r in got) == [(1, 1, False), (2, 1, True), (3, 3, False), (4, 3, True)]
    for r in got:
        passage = dict(rows[:7])[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode().lower().split()
        whole = inside if r["doc_id"] < 3 else across
        assert passage == whole and len(passage) == r["n_words"] and r["paragraph"] is None
    out = drop_repeated(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in out if r["text"] != rows[8][1]}
    assert len(out) == len(rows) and texts[1] == rows[0][1] and texts[3] == rows[2][1] and texts[5] == rows[4][1] and rows[8][1] in [r["text"] for r in out]
    assert texts[2].split() == rows[1][1].split()[:30] + rows[1][1].split()[90:] and len(texts[4].split()) == 18


def test_stretches_keep_to_their_rows():
    rng = np.random.default_rng(3)
    for _ in range(200):
        rows = np.concatenate([[0], np.cumsum(rng.integers(0, 9, rng.integers(1, 7)))])
        same = rng.random(rows[-1]) < 0.7
        want = []
        for r, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
            x = a
            while x < b:
                y = x
                while y < b and same[y]:
                    y += 1
                if y - x >= 2:
                    want.append((r, x - a, y - a))
                x = max(y, x + 1)
        assert list(zip(*(v.tolist() for v in equal_stretches(same, rows, 2)))) == want


def test_passage_inside_a_kept_line(spark):
    """A passage in a line whose copy goes is still found where the line stays, and goes to its ends."""
    text = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    passage, line = text("p", 70), text("c", 40) + text("p", 70) + text("d", 40)
    rows = [(1, " ".join(text("a", 40) + passage + text("b", 40))), (2, " ".join(line)), (3, " ".join(line)), (4, " ".join(text("e", 40) + passage + text("f", 40)))]
    docs = spark.createDataFrame(rows, DOC)
    got = {(r["doc_id"], r["paragraph"], r["removed"], r["cluster_doc_id"], r["n_words"]) for r in repeated_passages(docs).collect()}
    assert got == {(2, 0, False, 2, 150), (3, 0, True, 2, 150), (1, None, False, 1, 70), (2, None, True, 1, 70), (4, None, True, 1, 70)}
    out = {r["doc_id"]: (r["text"] or "").split() for r in drop_repeated(docs).collect()}
    assert out == {1: rows[0][1].split(), 2: text("c", 40) + text("d", 40), 3: [], 4: text("e", 40) + text("f", 40)}


def long_windows(texts, n=50):
    """Every run of n words that stands in two places of the texts, stretches apart."""
    seen, twice = set(), set()
    for stretch in texts:
        w = stretch.lower().split()
        for i in range(len(w) - n + 1):
            gram = tuple(w[i : i + n])
            (twice if gram in seen else seen).add(gram)
    return twice


@pytest.mark.parametrize("seed", range(2))
def test_no_run_is_left_and_nothing_is_lost(spark, seed):
    """Random corpora that mix linked lines, runs inside kept lines, runs over lines and edits, by brute force."""
    rng = random.Random(seed)
    fresh = iter(range(10**6))
    word = lambda: f"w{next(fresh)}"
    runs = [[word() for _ in range(rng.randrange(50, 140))] for _ in range(6)]
    runs += [runs[0][20:] + [word() for _ in range(30)], runs[1][:70] + runs[2][:70]]
    lines = [[word() for _ in range(30)] + rng.choice(runs) + [word() for _ in range(rng.randrange(60))] for _ in range(5)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            if kind < 0.3:
                line = list(rng.choice(lines))
                line[rng.randrange(len(line))] = rng.choice([line[0], "edited"])
                parts.append(" ".join(line))
            elif kind < 0.7:
                run = rng.choice(runs)
                a = rng.randrange(len(run) // 4)
                w = [word() for _ in range(rng.randrange(40))] + run[a:] + [word() for _ in range(rng.randrange(40))]
                parts.append(" ".join(w) if rng.random() < 0.5 else "\n".join(" ".join(w[i : i + 7]) for i in range(0, len(w), 7)))
            else:
                parts.append(" ".join(word() for _ in range(rng.randrange(80))))
        rows.append((k, "\n".join(parts)))
    docs = spark.createDataFrame(rows, DOC)
    found = [r.asDict() for r in repeated_passages(docs).collect()]
    kept = []
    for k, text in rows:
        data, cuts = text.encode(), sorted((r["start_byte"], r["end_byte"]) for r in found if r["doc_id"] == k and r["removed"])
        at = 0
        for a, b in [*cuts, (len(data), len(data))]:
            kept.append(data[at : max(a, at)].decode())  # stretches between what goes
            at = max(at, b)
    assert long_windows(t for _, t in rows) and not long_windows(kept)
    left = {w for t in kept for w in t.lower().split()}
    for r in found:  # only lines with a near copy may lose a word for good
        if r["paragraph"] is None:
            mine = dict(rows)[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode().lower().split()
            assert len(mine) == r["n_words"] >= 20 and set(mine) <= left
    if not seed:
        by_text = {r["doc_id"]: r["text"] for r in drop_repeated(docs).collect()}
        assert sum(len(t.split()) for t in by_text.values()) == sum(len(t.split()) for t in kept)


def plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_brute_force():
    rng = random.Random(6)
    a = [[rng.randrange(6) for _ in range(rng.randint(1, 14))] for _ in range(80)]
    b = [[rng.randrange(6) for _ in range(rng.randint(1, 20))] for _ in range(80)]
    best, _ = local_alignment([np.array(x, np.uint64) for x in a], [np.array(x, np.uint64) for x in b])
    assert best.tolist() == [plain_alignment(x, y) for x, y in zip(a, b)]


def test_contaminated(spark):
    rng = random.Random(9)
    vocabulary = [f"u{k}" for k in range(2000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [make(40), make(25), make(300), ["one", "two"], []]
    edited = list(items[0])
    edited[5] = "changed"
    del edited[20]
    edited.insert(30, "more")
    clean = make(500)
    rows = [
        (1, " ".join(make(50) + items[0] + make(50))), (2, " ".join(make(30) + edited + make(10))), (3, " ".join(items[1]).upper()), (4, " ".join(make(700) + items[2] + make(5))),
        (5, " ".join(clean)), (6, None), (7, ""), (8, "one two"), (1, " ".join(items[1])), (None, " ".join(items[0])),
    ]
    docs = spark.createDataFrame([(k, t, -1) for k, t in rows], DOC + ", item_id int")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(0, " ".join(items[0])), (9, None)], "item_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in contaminated(docs, bench).collect())
    assert got == sorted([("1", 0), ("1", 1), ("2", 0), ("3", 1), ("4", 2), ("None", 0)])
    assert [r for r in contaminated(docs.where("doc_id = 3"), bench).collect()][0]["score"] == 1.0
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, bench).collect()) == [5, 6, 7, 8]
    assert drop_contaminated(docs, bench.limit(0)).count() == len(rows) and contaminated(docs.limit(0), bench).count() == 0


def test_partial_quotes_of_long_items(spark):
    """Quotes on either side of any border, and quotes that are a small share of their item."""
    rng = random.Random(19)
    make = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    items = [make(256), make(1000), make(100), make(129)]
    cuts = [(0, 78, 178), (0, 100, 150), (0, 206, 256), (1, 0, 50), (1, 475, 525), (1, 950, 1000), (1, 490, 525), (2, 30, 65), (3, 79, 129)]
    rows = [(k, " ".join(make(60) + items[i][a:b] + make(60))) for k, (i, a, b) in enumerate(cuts)] + [(100, " ".join(make(300))), (101, " ".join(make(50) + items[1][200:215] + make(50)))]
    docs = spark.createDataFrame(rows, DOC)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["begin_word"], r["end_word"]) for r in contaminated(docs, bench).collect()}
    assert set(got) == {(k, i) for k, (i, _, _) in enumerate(cuts)}
    assert all(60 <= a < b <= 60 + cuts[k][2] - cuts[k][1] for (k, _), (a, b) in got.items())
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, bench).collect()) == [100, 101]


@pytest.mark.parametrize("text", ["", "a", "a b c d", "a b c d e f", "  x y", "é É ß " * 3])
def test_shingle_counts(text):
    from buildlens.llm.textops import shingle_sets, word_hashes

    h, rows = word_hashes(pa.array(["z z", text, None]))
    _, offs = shingle_sets(h, rows)
    assert (np.diff(offs)[1], np.diff(rows)[1]) == (len(shingles(text)), len(words(text)))


def test_sorted_rows_and_shingle_sets():
    """Rows of all sizes, empty ones and those of fewer words than a shingle, against a set a row."""
    from buildlens.llm.textops import ngram_hashes, shingle_sets, sorted_rows

    rng = np.random.default_rng(4)
    size = np.concatenate([rng.integers(0, 70, 400), [0, 1, 4, 5, 6, 3000, 0]])
    rows = np.concatenate([[0], np.cumsum(size)])
    h = rng.integers(0, 3, rows[-1]).astype(np.uint64)
    h[rows[-2] - 40 : rows[-2]] = np.uint64(2**64 - 1)  # the largest value is one like others
    assert all((x == np.sort(h[a:b])).all() for a, b in zip(rows[:-1], rows[1:]) for x in [sorted_rows(h, rows)[a:b]])
    sets, offs = shingle_sets(h, rows)
    grams, at = ngram_hashes(h, rows, 5)
    for k, n in enumerate(size):
        own = sets[offs[k] : offs[k + 1]]
        assert (own == np.unique(grams[at[k] : at[k + 1]])).all() if n >= 5 else len(own) == (n > 0), k


def test_components_free_their_files(spark):
    """A long path takes many rounds; the shuffle files of the earlier ones are gone at the end."""
    from buildlens.llm.common import release
    from buildlens.llm.components import connected_components

    release(spark)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    out = connected_components(spark.range(2000).selectExpr("id as a", "id + 1 as b"))
    left = disk.getAllFiles().size() - before
    assert out.select("comp").distinct().count() == 1 and left < 20, left


def test_components_of_several_tasks(spark, monkeypatch):
    """Edges that more than one task contracts: rounds over the stars, against a search."""
    from buildlens.llm import components

    monkeypatch.setattr(components, "EDGES_A_TASK", 16)
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(1000, 1100)] + [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(5, 5), (7, 3), (None, 2)]
    near: dict = {}
    for a, b in edges[:-1]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want: dict = {}
    for k in sorted(near):
        todo = [] if k in want else [k]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = k
                todo += near[x]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["id"]: r["comp"] for r in got} == want and len(got) == len(want)


def test_few_edges_take_few_stages(spark):
    """A long path that fits a task takes no rounds of joins, each of which is a task a partition."""
    context = spark.sparkContext
    context.setJobGroup("few-edges", "components")
    try:
        assert connected_components(spark.range(2000).selectExpr("id as a", "id + 1 as b")).select("comp").distinct().count() == 1
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds}
    assert 0 < len(stages) < 12, len(stages)


def test_winnowed_and_bare_grams(spark):
    """The least of every window, the first of equals, against a loop; the grams that are counted are those that have places."""
    from buildlens.llm.substring_dedup import bare_grams, chosen_grams, winnowed

    rng = np.random.default_rng(6)
    for n, kinds, window in ((0, 3, 4), (40, 1, 5), (60, 2, 7), (90, 4, 31), (200, 9, 6), (300, 10**6, 31)):
        grams = rng.integers(0, kinds, n).astype(np.uint64)
        rows = np.concatenate([[0], np.sort(rng.integers(0, n + 1, 3)), [n]])
        want = {j + int(np.argmin(grams[j : j + window])) for a, b in zip(rows[:-1], rows[1:]) for j in range(a, b - window + 1)}
        assert winnowed(grams, rows, window).tolist() == sorted(want)
    words_ = [" ".join(rng.choice(["a", "b", "c"], 300 if k % 2 else 90)) for k in range(8)] + ["x " * 400, "", None]
    docs = spark.createDataFrame(list(enumerate(words_)), "doc_id bigint, text string")
    grams = sorted(r[0] for r in bare_grams(docs, 5).collect())
    assert grams and grams == sorted(r["gram"] for r in chosen_grams(docs, 5).collect())


def test_short_bytes():
    """Numbers of any size there and back, cell by cell; steps between words mostly take a byte."""
    from buildlens.llm.substring_dedup import short_bytes, short_values

    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        values = np.array([rng.integers(1 << rng.integers(36)) for _ in range(n)], np.int64)
        cells = np.sort(np.concatenate([[0, 0, n], rng.integers(0, n + 1, 5)]))
        data, upto = short_bytes(values)
        got, at = short_values(data, upto[cells])
        assert got.tolist() == values.tolist() and at.tolist() == cells.tolist()
    assert len(short_bytes(np.array([0, 1, 127, 128, 1 << 35 - 1]))[0]) == 1 + 1 + 1 + 2 + 5


def test_words_of_runs_are_shuffled_once(spark):
    """Texts that repeat one passage: their words go to its holder once, in few bytes, and not again as if they held it."""
    rng = random.Random(4)
    fresh = iter(range(10**6))
    word = lambda: f"{'w' * rng.randrange(12)}{next(fresh)}"
    passage = " ".join(word() for _ in range(90))
    some = lambda: " ".join(word() for _ in range(40))
    texts = {k: f"{some()} {passage}  {some()}" for k in range(600)} | {600: "\u00e9" * 200 + " " + "x" * 40_000 + f" {passage.upper()} \u00df"}
    context = spark.sparkContext
    context.setJobGroup("words-once", "runs")
    try:
        found = repeated_passages(spark.createDataFrame(list(texts.items()), DOC)).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len({r["doc_id"] for r in found if r["removed"]}) == sum(r["removed"] for r in found) == 600
    for r in found:
        mine = texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode().lower()
        assert mine in passage and len(mine.split()) == r["n_words"] >= 20
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("words-once") for s in tracker.getJobInfo(j).stageIds}
    moved = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if tracker.getStageInfo(s))
    assert 0 < moved < 4_500_000, moved
