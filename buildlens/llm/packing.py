"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm import tokens
from buildlens.llm.common import binary_values, bound_batches, checkpoint, column, list_binary, slices, table

CAPACITY = 2048
#: Pieces that one genetic run packs together; waste is about half a sequence a run.
SHARD = 8192
ISLANDS = 2
POPULATION = 3
GENERATIONS = 200
#: Generations without a better packing after which an island rests.
PATIENCE = 4
#: Displaced items that look for exchanges in a crossover, and open bins that they look at; all others are best-fitted.
LOOSE = 64
EXCHANGED = 64


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32, as asked).

    A document is its ids and a closing 0.  Only a longer one than `capacity` is cut:
    the first piece takes the remainder, the others are full.  Null texts are empty:
    one piece, the closing id.  Every row of `docs` counts for itself.  A special text of
    the tokenizer (its end mark) that a document spells out is its one special id, as the
    tokenizer has it by default.
    """
    bound_batches(docs.sparkSession)
    path = path or tokens.default_path()
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, tokens.special_tokens(path))
        for batch in batches:
            for part in slices(batch, "__text"):
                ids, offs = enc.encode(column(part, "__text"))
                n = len(offs) - 1
                size = np.diff(offs) + 1
                ends = np.cumsum(size)
                flat = np.zeros(int(ends[-1]), dtype="<u4")
                keep = np.ones(len(flat), dtype=bool)
                keep[ends - 1] = False
                flat[keep] = ids
                count = -(-size // capacity)
                row = np.repeat(np.arange(n), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = size - capacity * (count - 1)
                start = np.where(piece == 0, 0, first[row] + capacity * (piece - 1))
                length = np.where(piece == 0, first[row], capacity)
                base = (ends - size)[row] + start
                raw = memoryview(flat.tobytes())
                crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(base.tolist(), length.tolist())]
                out = [column(part, "doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(list_binary(flat, np.append(base, len(flat))))
                yield pa.RecordBatch.from_arrays(out, names=[x.split(" ")[0] for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)


class Bins:
    """Bins by their free room; the best fit is found by one bit operation."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free = capacity, [], []
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0

    def _put(self, b: int) -> None:
        room = self.free[b]
        self.by_room.setdefault(room, []).append(b)
        self.mask |= 1 << room

    def add_bin(self, items: list[int], used: int) -> None:
        self.items.append(items)
        self.free.append(self.capacity - used)
        self._put(len(self.items) - 1)

    def best_fit(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.add_bin([item], size)
            return
        room = size + (fits & -fits).bit_length() - 1
        same = self.by_room[room]
        b = same.pop()
        if not same:
            self.mask &= ~(1 << room)
        self.items[b].append(item)
        self.free[b] = room - size
        self._put(b)


def _pack(order: list[int], sizes: list[int], capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    bins = Bins(capacity)
    for b in start:
        bins.add_bin(b, sum(sizes[i] for i in b))
    for i in order:
        bins.best_fit(i, sizes[i])
    return bins.items


def fitness(solution: list[list[int]], sizes: list[int], capacity: int) -> float:
    """Mean squared fill: rewards full bins beside open ones."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in solution) / max(len(solution), 1)


def _fill(b: list[int], used: int, loose: list[tuple[int, int]], sizes: list[int], capacity: int) -> int:
    """Exchange an item of a bin for one or two loose ones, or two for one, so that it is fuller; gives how full it is.

    `loose` has (size, item) in order.  Small loose items are the easiest to place afterwards, so a
    fuller bin is a step forward whatever comes back.
    """
    while loose:
        best: tuple[int, list[int], list[int]] | None = None

        def offer(gain: int, out: list[int], into: list[int]) -> None:
            nonlocal best
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, out, into

        room = capacity - used
        if not room:
            break
        outs = [(sizes[x], [x]) for x in b] + [(sizes[x] + sizes[y], [x, y]) for n, x in enumerate(b) for y in b[:n]]
        for size, out in outs:
            k = bisect.bisect_right(loose, (size + room, len(sizes))) - 1
            if k >= 0:
                offer(loose[k][0] - size, out, [k])
            if len(out) == 1:  # two loose ones that come nearest to the room, from both ends
                lo, hi = 0, len(loose) - 1
                while lo < hi:
                    both = loose[lo][0] + loose[hi][0]
                    if both <= size + room:
                        offer(both - size, out, [lo, hi])
                        lo += 1
                    else:
                        hi -= 1
        if best is None:
            break
        gain, out, into = best
        used += gain
        for k in sorted(into, reverse=True):
            b.append(loose.pop(k)[1])
        for x in out:
            b.remove(x)
            bisect.insort(loose, (sizes[x], x))
    return used


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Well-filled bins of b go into a whole; a's bins with their items dissolve, and the displaced items are best-fitted.

    Bins of a without room stay as they are: only the open ones are worth crossing.  Before the
    displaced items are fitted, they are exchanged for items of open bins that these make fuller.
    """
    used = [sum(sizes[i] for i in x) for x in a]
    closed = [x for x, n in zip(a, used) if n == capacity]
    settled = {i for x in closed for i in x}
    ranked = sorted((x for x in b if settled.isdisjoint(x)), key=lambda x: (-sum(sizes[i] for i in x), x[0]))
    good = ranked[: max(1, len(ranked) // 2)]
    gift = [list(x) for x in good if rng.random() < 0.5] or [list(x) for x in good[:1]]
    inside = {i for x in gift for i in x}
    kept, displaced = [], []
    for x, n in zip(a, used):
        if n == capacity:
            continue
        if inside.isdisjoint(x):
            kept.append((n, list(x)))
        else:
            displaced += [i for i in x if i not in inside]
    kept.sort(key=lambda x: (x[0], x[1]))
    worst = max(1, len(kept) // 50)  # mutation: the emptiest bins dissolve as well
    displaced += [i for _, x in kept[:worst] for i in x]
    kept = kept[worst:]
    loose = sorted((sizes[i], i) for i in displaced)
    if len(loose) > LOOSE:  # the largest are the hardest to place: they are fitted first, the rest looks for exchanges
        first, loose = loose[LOOSE:], loose[:LOOSE]
    else:
        first = []
    tried = kept if len(kept) <= EXCHANGED else rng.sample(kept, EXCHANGED)
    for n, x in tried:
        _fill(x, n, loose, sizes, capacity)
    rest = sorted(first + loose, key=lambda x: (-x[0], x[1]))
    return _pack([i for _, i in rest], sizes, capacity, closed + gift + [x for _, x in kept])


def evolve(sizes: list[int], capacity: int, seed: int, founders: list[list[list[int]]], population: int = POPULATION, generations: int = GENERATIONS, patience: int = PATIENCE) -> list[list[int]]:
    """The elite of one island: the best offspring, unless a founder needs fewer bins.

    Generations follow until an offspring reaches the least number of bins that the sizes allow,
    or `patience` of them bring no better one, one at least.  `founders` (the elites of an epoch
    before) join the population; the others are best-fit packings of random orders, the first from
    large to small.
    """
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    people = [(x, 0) for x in founders]
    while len(people) < max(population, 2):
        spread = 1.25 if people else 1.0
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i] * rng.uniform(1 / spread, spread), i))
        people.append((_pack(order, sizes, capacity), 0))
    key = lambda one: (len(one[0]), one[1] == 0, -fitness(one[0], sizes, capacity))
    stale = 0
    for born in range(1, generations + 1):
        best = min(map(key, people))
        children = [(crossover(x[0], y[0], sizes, capacity, rng), born) for x, y in (rng.sample(people, 2) for _ in range(max(population - 1, 1)))]
        people = sorted(people + children, key=key)[:population]
        stale = 0 if key(people[0]) < best else stale + 1
        if people[0][1] and (len(people[0][0]) <= least or stale >= patience):
            break
    return min(people, key=key)[0]


def _bins_of(assigned: np.ndarray) -> list[list[int]]:
    order = np.argsort(assigned, kind="stable")
    cuts = np.flatnonzero(np.diff(assigned[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(order) else []


def _assigned(solution: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(solution):
        out[b] = k
    return out


def _epoch(capacity: int, epoch: int):
    """One epoch of every (shard, island) row; elites come and go as item-to-bin arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                sizes = np.asarray(row.lengths).tolist()
                founders = [_bins_of(np.frombuffer(x, np.int32)) for x in (getattr(row, "elite", None), getattr(row, "migrant", None)) if x is not None]
                best = evolve(sizes, capacity, 1_000_003 * row.shard + 101 * row.island + epoch, founders)
                out.append((row.shard, row.island, row.lengths, _assigned(best, len(sizes)).tobytes(), len(best), fitness(best, sizes, capacity)))
            yield pd.DataFrame(out, columns=["shard", "island", "lengths", "elite", "bins", "fit"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = 2) -> DataFrame:
    """`pieces` with sequence_id and offset; few sequences, none over `capacity`.

    `pieces` has a column length of 1 to `capacity`.  Full pieces are sequences of
    their own.  The others are dealt at random to shards of about `shard` pieces;
    a shard is packed by islands, each with a population of its own, and after an
    epoch every island gets the elite of its neighbour.  The best island's packing
    is the shard's.  Nothing grows with the input but the number of shards.

    Ties between packings go to the fuller bins, then to the lesser island.  Rows that
    repeat are pieces of their own; an empty table gives an empty one.
    """
    pieces = checkpoint(pieces).withColumn("__pid", F.monotonically_increasing_id())
    n = pieces.where(F.col("length") < capacity).count()
    shards = max(1, round(n / shard))
    open_ = pieces.where(F.col("length") < capacity).select("__pid", F.col("length").cast("int").alias("len"), F.pmod(F.xxhash64("__pid"), F.lit(shards)).cast("int").alias("shard"))
    # Equal lengths can stand for each other, but the order must be the same for all islands.
    dealt = checkpoint(open_.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("len", "__pid"))).alias("items")))
    state = dealt.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.col("items.len").alias("lengths"))
    wide = max(1, min(shards * islands, 10 * pieces.sparkSession.sparkContext.defaultParallelism))
    schema = "shard int, island int, lengths array<int>, elite binary, bins int, fit double"
    for epoch in range(epochs):
        state = checkpoint(state.repartition(wide, "shard", "island").mapInPandas(_epoch(capacity, epoch), schema))
        if epoch + 1 < epochs:
            guest = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("migrant"))
            state = state.select("shard", "island", "lengths", "elite").join(guest, ["shard", "island"])
    best = state.groupBy("shard").agg(F.min_by("elite", F.struct("bins", -F.col("fit"), "island")).alias("elite"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elites, cuts = binary_values(column(batch, "elite"), np.int32)
            for r in range(batch.num_rows):
                items = column(batch, "items")[r].values
                length = items.field("len").to_numpy().astype(np.int64)
                bins = elites[cuts[r] : cuts[r + 1]]
                order = np.argsort(bins, kind="stable")
                done = np.cumsum(length[order]) - length[order]
                first = np.flatnonzero(np.append(True, np.diff(bins[order]) != 0)) if len(order) else order
                offset = np.empty(len(bins), dtype=np.int64)
                offset[order] = done - np.repeat(done[first], np.diff(np.append(first, len(order))))
                seq = (column(batch, "shard")[r].as_py() << 32) + bins.astype(np.int64)
                yield pa.RecordBatch.from_arrays([items.field("__pid"), pa.array(seq), pa.array(offset)], names=["__pid", "sequence_id", "offset"])

    placed = dealt.join(best, "shard").select("shard", "items", "elite").mapInArrow(place, "__pid bigint, sequence_id bigint, offset bigint")
    out = pieces.join(placed, "__pid", "left")
    return out.withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("__pid"))).withColumn("offset", F.coalesce("offset", F.lit(0).cast("bigint"))).drop("__pid")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row a piece.

    Null and empty texts are one piece of the closing id alone; texts of any length are cut
    whole.  Repeated rows are packed each; a null doc_id stays null; an empty table gives an
    empty one.  Columns other than doc_id and text are not read.
    """
    return pack(cut_pieces(docs, capacity, path), capacity)


def packed_ids(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """As pack_documents, with the ids of every piece (little-endian uint32)."""
    return pack(cut_pieces(docs, capacity, path, with_ids=True), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op8_packing": op8_packing}
