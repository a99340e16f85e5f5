"""Near-duplicate linking of texts: HyperMinHash banding, estimate, exact confirmation.

Shared by the document operator (`minhash_dedup`) and the paragraph operator
(`substring_dedup`).  Texts with equal shingle sets are one node.  Nodes that meet in
a band are linked if their sets, compared in full, have a Jaccard similarity of 0.75
or more.  Components need no list of all pairs, so a bucket is worked off in two steps:

1. every node is tried against the least node of each of its buckets (a star, as many
   pairs as rows), which joins the bulk of any group of copies;
2. in the buckets that still hold several components, signatures are compared in tiles
   of bounded size; rows with a partner in another component that may be similar
   enough bring their whole sets, the tile computes all intersections at once, and
   hands on a spanning forest of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm import hyperminhash as hmh
from buildlens.llm.common import binary_values, bound_batches, boundaries, checkpoint, column, list_binary, release, slices, sorted_groups
from buildlens.llm.components import connected_components
from buildlens.llm.textops import mix64, segment_reduce, shingle_sets, word_hashes

SHINGLE = 5
#: similarity >= 75 / 100
PERCENT = 75
#: Bands of four: a pair at 0.75 meets in none with probability 5e-6.
DOCUMENTS = hmh.Banding.tuned(4, PERCENT / 100, 1 - 5e-6)
#: Rows of a tile; a bucket of more rows is cut into blocks, and every pair of blocks is a tile.
TILE = 1024


def nodes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, offsets, 16-byte fingerprints of the sets)."""
    return fingerprinted(*shingle_sets(*word_hashes(texts), SHINGLE))


def fingerprinted(grams: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets with their fingerprints."""
    one = segment_reduce(np.add, mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), offs)
    two = segment_reduce(np.bitwise_xor, mix64(grams * np.uint64(0xDA942042E4DD58B5)), offs)
    size = np.diff(offs).astype(np.uint64)
    print_ = np.stack([mix64(one + size), mix64(two ^ (size << np.uint64(32)))], axis=1)
    return grams, offs, print_


def fingerprint_cells(prints: np.ndarray) -> pa.Array:
    n = len(prints)
    return list_binary(np.ascontiguousarray(prints).ravel(), np.arange(n + 1) * 2)


def sketch_cells(grams: np.ndarray, offs: np.ndarray, banding: hmh.Banding | None) -> list[pa.Array]:
    """Columns n_shingles, node and, with a banding, sig of sets."""
    _, _, prints = fingerprinted(grams, offs)
    cells = [pa.array(np.diff(offs), pa.int64()), fingerprint_cells(prints)]
    if banding is None:
        return cells
    sig = hmh.signatures(grams, offs, banding)
    return [*cells, list_binary(sig.ravel(), np.arange(len(sig) + 1) * banding.registers)]


def same_node(texts: pa.Array, nodes: pa.Array) -> pa.Array:
    """Mask of the texts whose sets have the fingerprint beside them."""
    _, _, prints = nodes_of(texts)
    return pa.array([x == y for x, y in zip(fingerprint_cells(prints).to_pylist(), nodes.to_pylist())], pa.bool_())


def sketch(df: DataFrame, keys: list[str], text: str, banding: hmh.Banding | None) -> DataFrame:
    """keys, n_shingles, node (fingerprint of the set) and, with a banding, sig (registers) of every row."""
    bound_batches(df.sparkSession)
    df = df.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]) + ", n_shingles bigint, node binary" + ", sig binary" * (banding is not None)
    names = [*keys, "n_shingles", "node", *["sig"] * (banding is not None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                cells = sketch_cells(*shingle_sets(*word_hashes(column(part, "__text")), SHINGLE), banding)
                yield pa.RecordBatch.from_arrays([*(column(part, k) for k in keys), *cells], names=names)

    return df.mapInArrow(run, schema)


def _bands(banding: hmh.Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, _ = binary_values(column(batch, "sig"), banding.dtype)
            keys = hmh.band_keys(sig.reshape(-1, banding.registers), banding.rows)
            n, b = keys.shape
            ids = column(batch, "id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(b, dtype=np.int32), n)), pa.array(np.repeat(ids, b))], names=["bucket", "band", "id"])

    return run


def _estimates(banding: hmh.Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, _ = binary_values(column(batch, "sig_a"), banding.dtype)
            b, _ = binary_values(column(batch, "sig_b"), banding.dtype)
            n = column(batch, "n_a").to_numpy()
            m = column(batch, "n_b").to_numpy()
            e = hmh.estimate(a.reshape(-1, banding.registers), b.reshape(-1, banding.registers), n, m, banding.mantissa) if len(n) else np.zeros(0)
            ok = (e >= banding.least) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(pa.array(ok)), column(batch, "b").filter(pa.array(ok))], names=["a", "b"])

    return run


def similar(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """100 * intersection >= 75 * union, in whole numbers."""
    return 100 * common >= PERCENT * (n + m - common)


def _sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, offsets) of the texts, a bounded number of bytes at a time."""
    values, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), "t"):
        h, rows = word_hashes(part.column(0))
        grams, offs = shingle_sets(h, rows, SHINGLE)
        values.append(grams)
        sizes.append(np.diff(offs))
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        va, oa = _sets_of(column(batch, "text_a"))
        vb, ob = _sets_of(column(batch, "text_b"))
        ok = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            ok[i] = similar(int((y[at] == x).sum()) if len(y) else 0, len(x), len(y))
        yield pa.RecordBatch.from_arrays([column(batch, "a").filter(pa.array(ok)), column(batch, "b").filter(pa.array(ok))], names=["a", "b"])


def _across(t: pa.Table, s: int, e: int) -> np.ndarray:
    """Mask of the pairs that a tile answers for: two blocks pair only with each other."""
    side = t["side"].to_numpy()[s:e]
    if t["t1"][s].as_py() == t["t2"][s].as_py():
        return np.ones((e - s, e - s), dtype=bool)
    return side[:, None] != side[None, :]


def _promising(banding: hmh.Banding):
    """Rows of a tile that may be similar to a row of another component.

    A pair counts only in the first band that it shares, so the many buckets of a
    group do not repeat each other's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["bucket", "t1", "t2"]
        for t in sorted_groups(batches, keys):
            sig, _ = binary_values(t["sig"], banding.dtype)
            sig = sig.reshape(-1, banding.registers)
            n, comp, band = t["n_shingles"].to_numpy(), t["comp"].to_numpy(), t["band"].to_numpy()
            keep = np.zeros(t.num_rows, dtype=bool)
            cuts = boundaries(t, keys)
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s < 2:
                    continue
                allowed = _across(t, s, e)
                for at in range(s, e, 64):
                    to = min(at + 64, e)
                    eq = sig[at:to, None, :] == sig[None, s:e, :]
                    shared = eq.reshape(to - at, e - s, -1, banding.rows).all(axis=3)
                    first = shared.argmax(axis=2) == band[s]
                    share = eq.mean(axis=2)
                    x = hmh.accidental(n[at:to, None], n[None, s:e], banding.mantissa)
                    lo, hi = np.minimum(n[at:to, None], n[None, s:e]), np.maximum(n[at:to, None], n[None, s:e])
                    good = first & ((share - x) / (1 - x) >= banding.least) & (comp[at:to, None] != comp[None, s:e]) & (100 * lo >= PERCENT * hi) & allowed[at - s : to - s]
                    keep[at:to] |= good.any(axis=1)
            yield from t.filter(pa.array(keep)).select(["bucket", "t1", "t2", "side", "id", "comp"]).to_batches()

    return run


def intersections(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections of the sets of one tile."""
    m = len(offs) - 1
    out = np.zeros((m, m), dtype=np.float64)
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    rank = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(m), np.diff(offs))
    use = shared[inverse]
    col, row = rank[inverse[use]], owner[use]
    width, order = int(shared.sum()), np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(col, [at, at + 4096])
        x = np.zeros((m, min(4096, width - at)), dtype=np.float32)
        x[row[lo:hi], col[lo:hi] - at] = 1
        out += x @ x.T
    return out.astype(np.int64)


def spanning(links: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
    """Links that join two so far separate parts; `start` has the parts to begin with."""
    _, part = np.unique(start, return_inverse=True)
    root = list(range(int(part.max()) + 1 if len(part) else 0))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(links, 1))):
        a, b = find(part[i]), find(part[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["bucket", "t1", "t2"]
    for t in sorted_groups(batches, keys):
        values, offs = _sets_of(t["text"].combine_chunks() if isinstance(t["text"], pa.ChunkedArray) and t["text"].num_chunks == 1 else pa.concat_arrays(t["text"].chunks))
        n, ids, comp = np.diff(offs), t["id"].to_numpy(), t["comp"].to_numpy()
        a: list[int] = []
        b: list[int] = []
        cuts = boundaries(t, keys)
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s < 2:
                continue
            common = intersections(values[offs[s] : offs[e]], offs[s : e + 1] - offs[s])
            links = similar(common, n[s:e, None], n[None, s:e]) & (comp[s:e, None] != comp[None, s:e]) & _across(t, s, e)
            for i, j in spanning(links, comp[s:e]):
                a.append(int(ids[s + i]))
                b.append(int(ids[s + j]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def texts_of(df: DataFrame, wanted: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(id, text) of the wanted nodes, read again: a text compresses far better than its set of hashes.

    `wanted` has id, node and the keys of one row; rows of equal keys with another
    text are told apart by the fingerprint.
    """
    right = wanted.select("id", F.col("node").alias("__node"), *[F.col(k).alias(f"__k_{k}") for k in keys])
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    rows = df.select(*keys, F.col(text).cast("string").alias("__text")).join(right, on).select("id", "__node", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                mask = same_node(column(part, "__text"), column(part, "__node"))
                yield pa.RecordBatch.from_arrays([column(part, "id").filter(mask), column(part, "__text").filter(mask)], names=["id", "text"])

    # rows that repeat keys and text are equal
    return rows.mapInArrow(run, "id bigint, text string").groupBy("id").agg(F.first("text").alias("text"))


def link(drawn: DataFrame, rows: DataFrame, fetch: Callable[[DataFrame, int], DataFrame], banding: hmh.Banding = DOCUMENTS, rounds: int = 1) -> DataFrame:
    """The columns of `rows`, and comp.

    `drawn` has keys, n_shingles, node and sig of every text, `rows` the same but sig
    (large registers are not kept on disk till the end for them); `fetch` gives (id, text),
    once each, for a frame of id, node and keys, a share of them in each of `rounds` calls.  comp is equal exactly for rows whose
    texts are joined by links; rows without a shingle have a comp of null.  The keys
    should tell rows with different texts apart; equal keys with different texts are
    still handled as separate nodes.
    """
    spark = drawn.sparkSession
    keys = [c for c in drawn.columns if c not in ("n_shingles", "node", "sig")]
    whole = drawn.where("n_shingles > 0")
    pick = F.max(F.struct(*keys)).alias("__key")
    nodes = whole.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), pick)
    nodes = checkpoint(nodes.withColumn("id", F.monotonically_increasing_id()))
    release(spark)

    # a node has a row for each bucket of its, so a bucket of two rows has two nodes
    bands = nodes.select("id", "sig").mapInArrow(_bands(banding), "bucket bigint, band int, id bigint")
    several = bands.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1").select("bucket")
    shared = checkpoint(bands.join(several, "bucket"))
    met = checkpoint(shared.join(shared.groupBy("bucket").agg(F.min("id").alias("lead")), "bucket"))
    release(spark)

    sig = nodes.select("id", "n_shingles", "sig")
    one = sig.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    two = sig.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
    star = met.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    star = checkpoint(star.join(one, "a").join(two, "b").mapInArrow(_estimates(banding), "a bigint, b bigint"))

    wanted = nodes.join(met.select("id").distinct(), "id", "left_semi").select("id", "node", *[F.col(f"__key.{k}").alias(k) for k in keys])
    parts = []
    for k in range(rounds):
        parts.append(checkpoint(fetch(wanted, k)))
        release(spark)
    texts = reduce(DataFrame.union, parts)
    text_a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    text_b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    edges = checkpoint(star.join(text_a, "a").join(text_b, "b").mapInArrow(_confirm, "a bigint, b bigint"))

    comps = connected_components(edges)
    here = met.join(comps, "id", "left").select("bucket", "band", "id", F.coalesce("comp", "id").alias("comp"))
    open_ = here.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket", F.ceil(F.col("rows") / TILE).cast("int").alias("blocks"))
    tiles = here.join(open_, "bucket").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("bucket", "band", "id", "comp", F.least("blk", "other").alias("t1"), F.greatest("blk", "other").alias("t2"), F.col("blk").alias("side"))
    order = ["bucket", "t1", "t2", "id"]
    near = tiles.join(sig, "id").repartition("bucket", "t1", "t2").sortWithinPartitions(*order)
    near = near.select("bucket", "band", "t1", "t2", "side", "id", "comp", "n_shingles", "sig").mapInArrow(_promising(banding), "bucket bigint, t1 int, t2 int, side int, id bigint, comp bigint")
    near = checkpoint(near)
    release(spark)
    more = near.join(texts, "id").repartition("bucket", "t1", "t2").sortWithinPartitions(*order)
    more = checkpoint(more.select("bucket", "t1", "t2", "side", "id", "comp", "text").mapInArrow(_tile_links, "a bigint, b bigint"))

    release(spark)

    # Components of components: the later links join earlier components, so only those are run again.
    label = comps.select("id", "comp")
    lifted = more.join(label.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").join(label.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
    merged = connected_components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    final = nodes.select("node", "id").join(label, "id", "left").select("node", F.coalesce("comp", "id").alias("mid"))
    final = final.join(merged.select(F.col("id").alias("mid"), F.col("comp").alias("top")), "mid", "left").select("node", F.coalesce("top", "mid").alias("comp"))
    return rows.join(final, "node", "left").withColumn("comp", F.when(F.col("n_shingles") > 0, F.col("comp")))
