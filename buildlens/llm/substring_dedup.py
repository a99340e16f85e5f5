"""Repeated passages, within and across documents: near-equal paragraphs, and equal runs of words anywhere.

Paragraphs are compared by their shingle sets.  What stays after that is searched for runs by
winnowing: of every few consecutive grams of words the least hash is chosen, so equal runs of
enough words choose an equal gram, wherever lines break round them.  Grams only propose: the words
round them are fetched from both texts and compared one by one (by 64-bit hashes of their own), and
what is equal there, to its ends, is a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import binary_values, bound_batches, checkpoint, column, list_binary, release, slices, table
from buildlens.llm.components import connected_components
from buildlens.llm.hyperminhash import LONG, Banding
from buildlens.llm.neardup import PERCENT, SHINGLE, link, same_node, sketch_cells
from buildlens.llm.textops import hash_ranges, ngram_hashes, shingle_sets, split_words, utf8

#: Paragraphs with fewer words are too short to count as repeated passages.
MIN_WORDS = 20
#: Paragraphs are many, and unrelated ones hardly share a shingle: bands of two need the fewest rows for this recall.
#: Two registers of four bytes tell the paragraphs of any corpus apart, where two of two bytes meet by chance.
PARAGRAPHS = Banding.tuned(2, PERCENT / 100, 1 - 1e-5, LONG)
#: Candidates' texts are fetched in so many rounds, each of which shuffles its share of the corpus.
FETCHES = 2
#: Consecutive grams of `min_words` words of which one is chosen: equal runs of min_words + WINDOW - 1 = 50 words share one.
WINDOW = 31


def _row_key() -> Column:
    """Tells rows with equal ids and different texts apart."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _row_key().alias("row"), F.col("text").cast("string").alias("__text"))


def _lines(part: pa.RecordBatch, min_words: int) -> tuple:
    """(bytes, row offsets, words, row, number, begin, end, first word, end word) of the lines of enough words of a slice."""
    data, offs = utf8(column(part, "__text"))
    words = split_words(column(part, "__text"))
    breaks = np.flatnonzero(data == 10)
    # a line begins with its row or behind a break of it; one behind a closing break is empty
    row = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs[1:], breaks, side="right")])
    begin = np.concatenate([offs[:-1], breaks + 1])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end = np.where(last, offs[1:][row], np.append(begin[1:], 0) - 1)
    number = np.arange(len(begin)) - np.searchsorted(row, row)
    first, to = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
    keep = np.flatnonzero(to - first >= min_words)
    return data, offs, words, row[keep], number[keep], begin[keep], end[keep], first[keep], to[keep]


_PLACE = "doc_id bigint, row bigint, paragraph int, start_byte bigint, end_byte bigint, n_words bigint"


def _place(part: pa.RecordBatch, lines: tuple) -> list[pa.Array]:
    _, offs, _, row, number, begin, end, first, to = lines
    owner = pa.array(row)
    return [column(part, "doc_id").take(owner), column(part, "row").take(owner), pa.array(number.astype(np.int32)), pa.array(begin - offs[row]), pa.array(end - offs[row]), pa.array((to - first).astype(np.int64))]


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row, paragraph, start_byte, end_byte, n_words, text of the \\n-split lines with enough words.

    `paragraph` counts all lines of the text from 0; byte offsets are of the UTF-8 text;
    `row` is equal for rows of equal id and text.  Null and empty texts have no paragraph.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                lines = _lines(part, min_words)
                raw = lines[0].tobytes()
                text = pa.array([raw[a:b] for a, b in zip(lines[5].tolist(), lines[6].tolist())], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*_place(part, lines), text], names=["doc_id", "row", "paragraph", "start_byte", "end_byte", "n_words", "text"])

    return _keyed(docs).mapInArrow(run, _PLACE + ", text string")


def _sketched(docs: DataFrame, min_words: int, banding: Banding | None) -> DataFrame:
    """The paragraphs' places and sketches, without their texts: words are hashed once a text."""
    names = ["doc_id", "row", "paragraph", "start_byte", "end_byte", "n_words", "n_shingles", "node", *["sig"] * (banding is not None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                lines = _lines(part, min_words)
                _, _, words, _, _, _, _, first, to = lines
                size = to - first
                rows = np.concatenate([[0], np.cumsum(size)])
                at = np.arange(rows[-1]) + np.repeat(first - rows[:-1], size)
                h = hash_ranges(words.data, words.start, words.end)[at]
                cells = sketch_cells(*shingle_sets(h, rows, SHINGLE), banding)
                yield pa.RecordBatch.from_arrays([*_place(part, lines), *cells], names=names)

    return _keyed(docs).mapInArrow(run, _PLACE + ", n_shingles bigint, node binary" + ", sig binary" * (banding is not None))


def _texts(docs: DataFrame, wanted: DataFrame, part: int, parts: int) -> DataFrame:
    """(id, text) of wanted paragraphs of one part of all texts; `wanted` has id, node and a paragraph's place."""
    mine = F.pmod(F.col("row"), F.lit(parts)) == part
    spans = wanted.where(mine).groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("id", "node", "start_byte", "end_byte")).alias("spans"))
    rows = _keyed(docs).where(mine).join(spans, F.col("row") == F.col("__row")).select("__text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                data, offs = utf8(column(part, "__text"))
                raw = data.tobytes()
                spans = column(part, "spans")
                flat, n = spans.flatten(), pc.list_value_length(spans).to_numpy()
                base = np.repeat(offs[:-1], n)
                begin, end = flat.field("start_byte").to_numpy() + base, flat.field("end_byte").to_numpy() + base
                text = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
                valid = pa.array(end <= np.repeat(offs[1:], n))  # another text of the same row key may be shorter
                text, ids, nodes = text.filter(valid), flat.field("id").filter(valid), flat.field("node").filter(valid)
                text = pa.array([x.decode("utf-8", "replace") for x in text.to_pylist()], pa.string())
                mask = same_node(text, nodes)
                yield pa.RecordBatch.from_arrays([ids.filter(mask), text.filter(mask)], names=["id", "text"])

    # rows that repeat id and text give equal paragraphs
    return rows.mapInArrow(run, "id bigint, text string").groupBy("id").agg(F.first("text").alias("text"))


def _spread(ufunc: np.ufunc, values: np.ndarray, window: int) -> np.ndarray:
    """ufunc of every `window` values in a row, from those of 1, 2, 4 ..."""
    width = 1
    while width < window:
        step = min(width, window - width)
        values, width = ufunc(values[:-step], values[step:]), width + step
    return values


def winnowed(grams: np.ndarray, rows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least gram, the first of equals, of every window within a row."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.int32), np.diff(rows))
    inside = row[:n] == row[window - 1 :]
    least = np.where(inside, _spread(np.minimum, grams, window), grams.dtype.type(0))
    # a gram is chosen where it is the least of some window: the greatest of their leasts is itself
    edge = np.zeros(window - 1, grams.dtype)
    pick = np.flatnonzero(_spread(np.maximum, np.concatenate([edge, least, edge]), window) == grams)
    # of equal ones, a later one only if a window of its begins behind the earlier; a 0 may also be no window's
    before = np.concatenate([[-window], pick[:-1]])
    doubt = np.flatnonzero((grams[pick] == 0) | (pick - before < window) & (grams[before] == grams[pick]))
    keep = np.ones(len(pick), bool)
    for some in np.array_split(doubt, len(doubt) // (1 << 16) + 1):
        i, p = pick[some, None], np.where(grams[before[some]] == grams[pick[some]], before[some], -1)[:, None]
        j = i - np.arange(window)
        at = np.clip(j, 0, n - 1)
        keep[some] = ((j > p) & (j == at) & inside[at] & (least[at] == grams[i])).any(axis=1)
    return pick[keep]


def _chosen(part: pa.RecordBatch, min_words: int) -> tuple:
    """(words, grams, offsets of each row's, chosen places) of a slice."""
    w = split_words(column(part, "__text"))
    grams, at = ngram_hashes(hash_ranges(w.data, w.start, w.end), w.rows, min_words)
    pick = winnowed(grams, at)
    same = np.zeros(len(grams), bool)
    same[1:] = grams[1:] == grams[:-1]
    if same.any():  # in a run of one repeated word all grams are equal: overlapping ones are enough
        since = np.arange(len(grams)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(grams))))
        pick = pick[since[pick] % max(min_words // 2, 1) == 0]
    return w, grams, at, pick


def bare_grams(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The column gram of `chosen_grams` alone: what counts them needs no places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                _, grams, _, pick = _chosen(part, min_words)
                yield pa.RecordBatch.from_arrays([pa.array(grams[pick].view(np.int64))], names=["gram"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("__text")).mapInArrow(run, "gram bigint")


def chosen_grams(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row, word, line, last_line, gram: the winnowed grams of min_words words of whole texts, and the \\n-split lines they begin and end in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                data, offs = utf8(column(part, "__text"))
                breaks = np.flatnonzero(data == 10)
                w, grams, at, pick = _chosen(part, min_words)
                row = np.searchsorted(at, pick, side="right") - 1
                word = pick - at[row]
                first = w.rows[row] + word
                above = np.searchsorted(breaks, offs[row])
                line, last_line = (pa.array((np.searchsorted(breaks, x) - above).astype(np.int32)) for x in (w.start[first], w.start[first + min_words - 1]))
                owner = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id").take(owner), column(part, "row").take(owner), pa.array(word), line, last_line, pa.array(grams[pick].view(np.int64))],
                    names=["doc_id", "row", "word", "line", "last_line", "gram"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id bigint, row bigint, word bigint, line int, last_line int, gram bigint")


def short_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of whole numbers below 2^35, seven bits a byte, lowest first; a number's last byte is under 128."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    upto = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(upto[-1], np.uint8)
    for k in range(size.max(initial=0)):
        has = size > k
        out[upto[:-1][has] + k] = values[has] >> 7 * k & 127 | (size[has] > k + 1) << 7
    return out, upto


def short_values(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of short_bytes: (values, offsets of the cells counted in values)."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    part = (data & 127).astype(np.int64) << 7 * (np.arange(len(data)) - np.repeat(first, last + 1 - first))
    return np.add.reduceat(part, first) if len(first) else part, np.searchsorted(last, offs)


def _word_runs(docs: DataFrame, wanted: DataFrame, part: int, parts: int) -> DataFrame:
    """(row, begin, end, of, shift, doc_id, first, start, words, places) of wanted word ranges of one part of all texts.

    `wanted` has row, begin, end, which may go beyond the text, and what else tells its rows apart:
    of and shift.  `first` is where the range begins in the text, in words, and `start` in bytes.
    `words` has a 64-bit hash of each word, A-Z as a-z, `places` the steps from `start` to its first
    byte, its end, the next word's first byte and so on: mostly two bytes a word.  Texts that repeat
    give their ranges again.
    """
    mine = F.pmod(F.col("row"), F.lit(parts)) == part
    spans = wanted.where(mine).groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("begin", "end", "of", "shift")).alias("spans"))
    rows = _keyed(docs).where(mine).join(spans, F.col("row") == F.col("__row")).select("row", "doc_id", "__text", "spans")
    names = ["row", "begin", "end", "of", "shift", "doc_id", "first", "start", "words", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                _, offs = utf8(column(part, "__text"))
                w = split_words(column(part, "__text"))
                h = hash_ranges(w.data, w.start, w.end)
                spans = column(part, "spans")
                flat, n = spans.flatten(), pc.list_value_length(spans).to_numpy()
                row = np.repeat(np.arange(part.num_rows), n)
                begin, end = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
                first = np.maximum(begin, 0)
                size = np.maximum(np.minimum(w.rows[row] + end, w.rows[row + 1]) - w.rows[row] - first, 0)
                upto = np.concatenate([[0], np.cumsum(size)])
                at = np.arange(upto[-1]) + np.repeat(w.rows[row] + first - upto[:-1], size)
                some = size > 0
                start = np.zeros(len(size), np.int64)
                start[some] = w.start[at[upto[:-1][some]]]
                steps = np.diff(np.column_stack([w.start[at], w.end[at]]).ravel(), prepend=0)
                steps[2 * upto[:-1][some]] = 0
                coded, cut = short_bytes(steps)
                start[some] -= offs[row[some]]
                cells = [pa.array(start), list_binary(h[at], upto), list_binary(coded, cut[2 * upto])]
                who = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "row").take(who), pa.array(begin), pa.array(end), flat.field("of"), flat.field("shift"), column(part, "doc_id").take(who), pa.array(first), *cells], names=names
                )

    return rows.mapInArrow(run, "row bigint, begin bigint, end bigint, of bigint, shift bigint, doc_id bigint, first bigint, start bigint, words binary, places binary")


def equal_stretches(same: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the longest runs of True of at least `least` within each row; begins and ends count from the row's."""
    n = len(same)
    on = np.concatenate([[False], same, [False]])
    edge = on[1:] != on[:-1]
    starts, ends = np.flatnonzero(edge & on[1:]), np.flatnonzero(edge & on[:-1])
    # a run that goes over a row's end is cut there
    cuts = rows[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[same[cuts - 1] & same[cuts]]
    starts, ends = np.unique(np.concatenate([starts, cuts])), np.unique(np.concatenate([ends, cuts]))
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    row = np.searchsorted(rows, starts, side="right") - 1
    return row, starts - rows[row], ends - rows[row]


_PAIRS = ", ".join(f"{side}{name} bigint" for side in ("", "of_") for name in ("row", "doc_id", "begin", "end", "start_byte", "end_byte"))


def _compared(min_words: int):
    """A row for every stretch in which the words fetched for a run agree with those of its holder, and where it lies in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _PAIRS.split(", ")]
        for batch in batches:
            take = lambda name: column(batch, name).to_numpy()
            own, held = binary_values(column(batch, "words"), np.uint64), binary_values(column(batch, "of_words"), np.uint64)
            # both from the same word on: the later of the two begins
            lead = take("first") - take("shift") - take("of_first")
            skip = np.maximum(-lead, 0), np.maximum(lead, 0)
            size = np.maximum(np.minimum(np.diff(own[1]) - skip[0], np.diff(held[1]) - skip[1]), 0)
            rows = np.concatenate([[0], np.cumsum(size)])
            at = [np.arange(rows[-1]) + np.repeat(offs[:-1] + more - rows[:-1], size) for (_, offs), more in zip((own, held), skip)]
            r, x, y = equal_stretches(own[0][at[0]] == held[0][at[1]], rows, min_words)
            out = []
            for side, (row, doc), index, more in (("", ("row", "doc_id"), at[0], skip[0]), ("of_", ("of", "of_doc_id"), at[1], skip[1])):
                steps, cell = short_values(*binary_values(column(batch, side + "places"), np.uint8))
                gone = np.concatenate([[0], np.cumsum(steps)])
                base = take(side + "start")[r] - gone[cell[r]]
                first_byte, last_byte = (base + gone[2 * index[rows[r] + i] + k] for i, k in ((x, 1), (y - 1, 2)))
                begin = take(side + "first")[r] + more[r]
                who = pa.array(r)
                out += [column(batch, row).take(who), column(batch, doc).take(who), pa.array(begin + x), pa.array(begin + y), pa.array(first_byte), pa.array(last_byte)]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _linked_lines(docs: DataFrame, min_words: int) -> DataFrame:
    keys = ["doc_id", "row", "paragraph", "start_byte", "end_byte", "n_words"]
    rows = link(_sketched(docs, min_words, PARAGRAPHS), _sketched(docs, min_words, None), lambda wanted, k: _texts(docs, wanted, k, FETCHES), PARAGRAPHS, FETCHES).where("comp is not null").select(*keys, "comp")
    rows = checkpoint(rows)  # read twice, and a row of it is a pass over its text
    first = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "paragraph")).alias("first"), F.count("*").alias("members")).where("members > 1")
    out = rows.join(first, "comp")
    out = out.select(*keys, F.col("first.doc_id").alias("cluster_doc_id"), F.col("first.paragraph").alias("cluster_paragraph"))
    same = F.col("doc_id").eqNullSafe(F.col("cluster_doc_id")) & (F.col("paragraph") == F.col("cluster_paragraph"))
    return checkpoint(out.withColumn("removed", ~same))


def _equal_runs(docs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """Runs of equal words in what the removal of `lines` leaves: the columns of `lines`, and row.

    The first place of a gram holds it; all other places are candidates for removal.  Grams of a
    text that lie alike to those of one holder, a window apart at most, propose one run; the words
    of both, a window further at either end, are compared.  Runs that overlap are one passage.
    """
    release(docs.sparkSession)
    grams = chosen_grams(docs, min_words)
    several = checkpoint(bare_grams(docs, min_words).groupBy("gram").agg(F.count("*").alias("places")).where("places > 1").select("gram"))
    # what goes with its line neither holds nor is removed again
    gone = lines.where("removed").groupBy(F.col("row").alias("__row")).agg(F.collect_set("paragraph").alias("__gone"))
    shared = grams.join(several, "gram").join(gone, F.col("row") == F.col("__row"), "left")
    touches = lambda line: F.coalesce(F.array_contains("__gone", F.col(line)), F.lit(False))
    shared = checkpoint(shared.where(~touches("line") & ~touches("last_line")).select("doc_id", "row", "word", "gram"))
    release(docs.sparkSession)
    place = F.struct("doc_id", "row", "word")
    # written first: a join of two plain shuffles can be split where a gram is very common
    held = checkpoint(shared.groupBy("gram").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1").select("gram", "first"))
    release(docs.sparkSession)
    later = shared.join(held, "gram").where((F.col("row") != F.col("first.row")) | (F.col("word") != F.col("first.word")))
    later = later.select("row", "word", F.col("first.row").alias("of"), (F.col("word") - F.col("first.word")).alias("shift"))
    order = Window.partitionBy("row", "of", "shift").orderBy("word")
    begins = F.coalesce(F.col("word") - F.lag("word").over(order) > WINDOW, F.lit(True)).cast("int")
    runs = later.withColumn("__new", begins).withColumn("__run", F.sum("__new").over(order)).groupBy("row", "of", "shift", "__run")
    runs = runs.agg((F.min("word") - WINDOW + 1).alias("begin"), (F.max("word") + min_words + WINDOW - 1).alias("end"))
    runs = checkpoint(runs.select("row", "begin", "end", "of", "shift"))
    del several, shared, held, later  # their files go with them
    # a run's words come with what it is to be compared with, so that only holders' ranges, of which many runs share one, are joined to them
    none = F.lit(None).cast("bigint")
    ranges = runs.select(F.col("of").alias("row"), F.col("begin") - F.col("shift"), F.col("end") - F.col("shift"), none, none)
    wanted = runs.union(ranges.distinct())
    parts = []
    for k in range(FETCHES):
        parts.append(checkpoint(_word_runs(docs, wanted, k, FETCHES)))
        release(docs.sparkSession)
    words = reduce(DataFrame.union, parts)
    key = {"row": "of", "begin": "of_begin", "end": "of_end"}
    value = ["doc_id", "first", "start", "words", "places"]
    # written first, as above; rows that repeat are equal
    other = checkpoint(words.where("of is null").groupBy(*[F.col(c).alias(k) for c, k in key.items()]).agg(*[F.first(c).alias(f"of_{c}") for c in value]))
    own = words.where("of is not null").withColumn("of_begin", F.col("begin") - F.col("shift")).withColumn("of_end", F.col("end") - F.col("shift"))
    pairs = checkpoint(own.join(other, list(key.values())).mapInArrow(_compared(min_words), _PAIRS))
    del runs, ranges, wanted, parts, words, other, own
    release(docs.sparkSession)
    return _passages(pairs)


def _passages(pairs: DataFrame) -> DataFrame:
    """Overlapping runs of a text as one passage, named after the least doc_id of its component.

    A passage that many texts repeat is one range of its holder: ranges are made distinct before a text's meet.
    """
    kept = pairs.select(*[F.col(f"of_{c}").alias(c) for c in ("row", "doc_id", "begin", "end", "start_byte", "end_byte")], F.lit(False).alias("removed"))
    ranges = pairs.select("row", "doc_id", "begin", "end", "start_byte", "end_byte", F.lit(True).alias("removed")).union(kept)
    ranges = ranges.groupBy("row", "removed", "begin", "end").agg(*[F.first(c).alias(c) for c in ("doc_id", "start_byte", "end_byte")])
    order = Window.partitionBy("row", "removed").orderBy("begin", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = checkpoint(ranges.withColumn("__new", F.coalesce(F.col("begin") >= reached, F.lit(True)).cast("int")).withColumn("nth", F.sum("__new").over(order)).drop("__new"))
    release(ranges.sparkSession)
    passages = ranges.groupBy("row", "removed", "nth").agg(F.first("doc_id").alias("doc_id"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), (F.max("end") - F.min("begin")).alias("n_words"))
    passages = checkpoint(passages.withColumn("id", F.monotonically_increasing_id()))
    ids = checkpoint(ranges.join(passages.select("row", "removed", "nth", "id"), ["row", "removed", "nth"]).select("row", "removed", "begin", "end", "id"))
    del ranges
    release(ids.sparkSession)
    own = ids.where("removed").select("row", "begin", "end", F.col("id").alias("a"))
    held = ids.where("not removed").select(F.col("row").alias("of_row"), F.col("begin").alias("of_begin"), F.col("end").alias("of_end"), F.col("id").alias("b"))
    edges = pairs.join(own, ["row", "begin", "end"]).select("a", "of_row", "of_begin", "of_end").distinct().join(held, ["of_row", "of_begin", "of_end"])
    comps = connected_components(edges.select("a", "b").distinct()).select("id", "comp")
    passages = passages.join(comps, "id")
    named = passages.groupBy("comp").agg(F.min(F.struct("doc_id")).alias("least"))
    none = F.lit(None).cast("int")
    return passages.join(named, "comp").select("doc_id", none.alias("paragraph"), "start_byte", "end_byte", "n_words", F.col("least.doc_id").alias("cluster_doc_id"), none.alias("cluster_paragraph"), "removed", "row")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row a paragraph that is linked with another, or a run of equal words elsewhere: doc_id, paragraph,
    start_byte, end_byte, n_words, cluster_doc_id, cluster_paragraph, removed.

    Paragraphs are linked at a Jaccard similarity of 0.75 or more of their 5-word
    shingles, confirmed on full sets.  The least (doc_id, paragraph) of a component names
    the cluster and stays; the others are removed.  Rows that repeat a document are
    copies of it, and every paragraph of the later copies would be removed; as equal ids
    cannot tell copies apart, rows with equal doc_id and paragraph share one verdict.
    A null doc_id sorts first.

    Runs have a null paragraph: they may be parts of lines or go over several.  They are sought in
    what the removed lines leave, each stretch between two of them for itself.  Of each run of
    min_words + WINDOW - 1 equal words (A-Z as a-z) in several places all but one lose it, so no
    such run is left; shorter ones of min_words are found by chance.  The least (doc_id, word)
    keeps the words (removed is false).  Runs are compared word by word and go to their ends,
    overlapping ones are one row.  Passages that share a run, directly or through others, are a
    cluster, named after its least doc_id.
    """
    lines = _linked_lines(docs, min_words)
    return lines.unionByName(_equal_runs(docs, lines, min_words)).drop("row")


def _cut(text, gone, cuts):
    """The text without the lines `gone` and the byte ranges `cuts`; lines that cuts empty go too."""
    if text is None:
        return None
    data, out, at, gone = text.encode(), [], 0, set(gone or ())
    cuts = sorted((c["start_byte"], c["end_byte"]) for c in cuts or ())
    k = 0
    for i, line in enumerate(data.split(b"\n")):
        end, done, kept = at + len(line), at, []
        while k < len(cuts) and cuts[k][0] < end:
            a, b = max(cuts[k][0], done), min(cuts[k][1], end)
            if a < b:
                kept.append(data[done:a])
                done = b
            if cuts[k][1] > end:
                break  # goes on in the next line
            k += 1
        kept = b"".join([*kept, data[done:end]])
        if i not in gone and (len(kept) == len(line) or kept.strip()):
            out.append(kept)
        at = end + 1
    return b"\n".join(out).decode()


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with removed paragraphs and runs cut out of the texts; all rows and columns stay."""
    lines = _linked_lines(docs, min_words)
    gone = lines.where("removed").groupBy(F.col("row").alias("__gone_row")).agg(F.collect_set("paragraph").alias("__gone"))
    cuts = _equal_runs(docs, lines, min_words).where("removed").groupBy("row").agg(F.collect_list(F.struct("start_byte", "end_byte")).alias("__cuts")).withColumnRenamed("row", "__cut_row")
    names = docs.columns
    docs = docs.select(F.struct("*").alias("__doc"), F.col("doc_id"), F.col("text"))  # other columns keep any names
    joined = docs.join(gone, _row_key() == F.col("__gone_row"), "left").join(cuts, _row_key() == F.col("__cut_row"), "left")
    kept = F.when(F.col("__gone").isNull() & F.col("__cuts").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.udf(_cut, "string")("text", "__gone", "__cuts"))
    return joined.select(*[(kept if c == "text" else F.col("__doc").getField(c)).alias(c) for c in names])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op6_substring_dedup": op6_substring_dedup}
