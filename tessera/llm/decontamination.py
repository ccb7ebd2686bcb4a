"""Operator 1: benchmark decontamination by greedy string tiling.

Every run of ``min_match`` words of a benchmark item is a seed. Documents are scanned once in the tasks that
read them: rolling word-window hashes are looked up among the seeds, which joins documents to items that
share tokens. For such a pair greedy string tiling marks the longest common run of unmarked words again and
again, finding runs by Karp-Rabin hashes at shrinking lengths. An item is leaked when the tiles cover
enough of it, in whatever order its passages stand in the document.

The benchmark is the query set. It is read in blocks of bounded size, each block's index is broadcast in its
turn, and every document is held against every block; documents never shuffle. An item of fewer words than a seed
is leaked by any document that holds it, as it stands; items that say only "yes" should not be in the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import grams, token_windows, word_hashes
from tessera.session import table

MIN_MATCH, COVERAGE = 5, 0.5
#: Tiling starts with runs of this length.
FIRST_LENGTH = 20
#: Text bytes of the benchmark items whose index is broadcast at once, on average; the index takes about five times as much.
BLOCK_BYTES = 32 << 20


# --- greedy string tiling ----------------------------------------------------------------------


def _before(words: np.ndarray, free: np.ndarray, at: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The number among ``names`` of the word before each place; as many as there are names where it is marked, unknown or none."""
    before = words[np.maximum(at - 1, 0)]
    found = np.minimum(np.searchsorted(names, before), max(len(names) - 1, 0))
    known = (at > 0) & (free[np.maximum(at - 1, 0)] > 0) & (names[found] == before) if len(names) else np.zeros(len(at), bool)
    return np.where(known, found, len(names))


def _matches(doc: np.ndarray, item: np.ndarray, doc_free: np.ndarray, item_free: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal runs (length, doc position, item position) of at least ``size`` unmarked equal words.

    Only pairs of places that begin a run are made: their windows agree and the words before them don't. So a text that
    repeats itself has as many pairs as it has words, not as many as words times words.
    """
    if size > min(len(doc), len(item)):
        return []
    di, ti = (np.flatnonzero(np.convolve(f, np.ones(size, np.int64), "valid") == size) for f in (doc_free, item_free))
    if not len(di) or not len(ti):
        return []
    seen, code = np.unique(token_windows(item, size)[ti], return_inverse=True)
    window = token_windows(doc, size)[di]
    at = np.minimum(np.searchsorted(seen, window), len(seen) - 1)
    common = seen[at] == window
    di, at = di[common], at[common]
    names = np.unique(item)
    wide = len(names) + 1
    before = _before(item, item_free, ti, names)
    order = np.lexsort((before, code))
    ti, keys = ti[order], (code * wide + before)[order]
    own = _before(doc, doc_free, di, names)
    first, last = np.searchsorted(keys, at * wide), np.searchsorted(keys, (at + 1) * wide)
    # of those, the ones behind the same word are parts of runs that begin earlier
    low, high = np.searchsorted(keys, at * wide + own), np.searchsorted(keys, at * wide + own, "right")
    low, high = (np.where(own == len(names), last, x) for x in (low, high))
    pairs = []
    for begin, end in ((first, low), (high, last)):
        n = end - begin
        j = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if n.sum() else np.zeros(0, np.int64)
        pairs.append((np.repeat(di, n), ti[j]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    n = _run_lengths(doc, item, doc_free, item_free, i, j)
    good = n >= size
    return list(zip(n[good].tolist(), i[good].tolist(), j[good].tolist(), strict=True))


def _run_lengths(doc: np.ndarray, item: np.ndarray, doc_free: np.ndarray, item_free: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 64) -> np.ndarray:
    """How many words agree and are unmarked from each pair of places on, STEP words at a time."""
    out, left = np.zeros(len(i), np.int64), np.arange(len(i))
    ahead = np.arange(step)
    while len(left):
        for part in np.array_split(left, max(1, len(left) // 20_000)):
            d, t = (i[part] + out[part])[:, None] + ahead, (j[part] + out[part])[:, None] + ahead
            inside = (d < len(doc)) & (t < len(item))
            d, t = np.minimum(d, len(doc) - 1), np.minimum(t, len(item) - 1)
            same = inside & (doc[d] == item[t]) & (doc_free[d] > 0) & (item_free[t] > 0)
            out[part] += np.where(same.all(1), step, same.argmin(1))
        left = left[(out[left] > 0) & (out[left] % step == 0) & (i[left] + out[left] < len(doc)) & (j[left] + out[left] < len(item))]
        left = left[(doc[i[left] + out[left]] == item[j[left] + out[left]]) & (doc_free[i[left] + out[left]] > 0) & (item_free[j[left] + out[left]] > 0)]
    return out


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (length, doc position, item position), longest first; each word is in one tile at most.

    Of equally long matches the one that stands first in the document, then in the item, is marked.
    """
    doc_free, item_free = np.ones(len(doc), np.int64), np.ones(len(item), np.int64)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(FIRST_LENGTH, len(doc), len(item)))
    while True:
        found = _matches(doc, item, doc_free, item_free, size)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        while found:
            longest = max(n for n, _, _ in found)
            later = []
            for n, i, j in sorted(m for m in found if m[0] == longest):
                if item_free[j] and item_free[j + n - 1] and doc_free[i : i + n].all() and item_free[j : j + n].all():
                    doc_free[i : i + n] = item_free[j : j + n] = 0
                    tiles.append((n, i, j))
                    if not item_free.any():
                        return tiles
                elif item_free[j : j + n].any():
                    later.append((n, i, j))
            # what is left of an occluded match counts as a shorter one
            found = [m for m in found if m[0] < longest] + [
                part for m in later for part in _unmarked(m, doc_free, item_free) if part[0] >= size
            ]
        if size == least:
            return tiles
        size = size // 2 if size > 2 * least else least


def _unmarked(match: tuple[int, int, int], doc_free: np.ndarray, item_free: np.ndarray) -> Iterator[tuple[int, int, int]]:
    n, i, j = match
    edges = np.flatnonzero(np.diff(np.concatenate([[0], doc_free[i : i + n] & item_free[j : j + n], [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield b - a, i + a, j + a


# --- the seeds of one block of the benchmark ---------------------------------------------------


@dataclass
class SeedIndex:
    """Items as word hashes, and by seed length: sorted distinct seeds, the items that hold each and how often."""

    ids: list
    words: list[np.ndarray]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def items_at(self, hashes: np.ndarray, offsets: np.ndarray, coverage: float) -> Iterator[tuple[int, int, np.ndarray, int]]:
        """(row, item, starts, length): places of the row's words at which seeds of the item stand.

        Items of which the row's seeds, however they stand, can't cover enough are left out before places are listed, so that a
        stock phrase in many items costs a row its distinct seeds times the items, not its places.
        """
        sizes = np.array([len(w) for w in self.words] or [0], np.int64)
        for length, (seeds, first, items, times) in self.by_length.items():
            windows = grams(hashes, length)
            at = np.flatnonzero(np.isin(windows, seeds))
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + length <= offsets[row + 1] if len(at) else np.zeros(0, bool)
            at, row = at[inside], row[inside]
            seed = np.searchsorted(seeds, windows[at])
            has = np.unique(row * len(seeds) + seed)
            own_row, own_seed = np.divmod(has, len(seeds))
            n = first[own_seed + 1] - first[own_seed]
            where = np.repeat(first[own_seed] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            pairs, inverse = np.unique(np.repeat(own_row, n) * len(self.words) + items[where], return_inverse=True)
            most = np.bincount(inverse, times[where], minlength=len(pairs)) * length
            for pair in pairs[most >= coverage * sizes[pairs % len(self.words)]].tolist():
                r, item = divmod(pair, len(self.words))
                lo, hi = np.searchsorted(row, [r, r + 1])
                yield r, item, at[lo:hi][np.isin(windows[at[lo:hi]], grams(self.words[item], length))], length


def seed_index(ids: list, texts: pa.Array, min_match: int) -> SeedIndex:
    """Seeds of the items; an item with fewer words than ``min_match`` is one seed, one without words none."""
    words = [h[o[i] : o[i + 1]] for _, o, h in word_hashes(texts) for i in range(len(o) - 1)]
    by_length = {}
    for length in {min(min_match, len(w)) for w in words} - {0}:
        own = [k for k, w in enumerate(words) if min(min_match, len(w)) == length]
        pairs = [(*np.unique(grams(words[k], length), return_counts=True), k) for k in own]
        seeds, times = (np.concatenate([p[x] for p in pairs]) for x in (0, 1))
        items = np.concatenate([np.full(len(s), k) for s, _, k in pairs])
        order = np.argsort(seeds, kind="stable")
        distinct, first = np.unique(seeds[order], return_index=True)
        by_length[length] = distinct, np.append(first, len(seeds)), items[order], times[order]
    return SeedIndex(ids, words, by_length)


def _covered(starts: np.ndarray, length: int, hashes: np.ndarray, at: int) -> np.ndarray:
    """Words of a row under seeds; a word that is in no text stands between runs that are apart.

    Every tile consists of seeds, so nothing outside the runs can be in one.
    """
    apart = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    begins, ends = starts[np.concatenate([[0], apart])], starts[np.concatenate([apart - 1, [len(starts) - 1]])] + length
    parts = [x for b, e in zip(begins.tolist(), ends.tolist(), strict=True) for x in (hashes[b:e], np.array([at], np.uint64))]
    return np.concatenate(parts[:-1])


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row and leaked item: id, item, ``covered`` (share of the item's words in tiles),
    ``tiles``, ``words`` (in tiles).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, lower-cased A-Z. A tile has ``min_match`` words at
    least (a shorter item: all its words). Null and empty texts, on either side, match nothing. Repeated
    document rows are each reported, items with equal texts too; null ids are carried through. An empty table
    gives an empty result. Other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(item_col, benchmark.schema[item_col].dataType),
            T.StructField("covered", T.DoubleType()),
            T.StructField("tiles", T.IntegerType()),
            T.StructField("words", T.IntegerType()),
        ]
    )
    out = None
    for sent, item_type in _blocks(benchmark, item_col, item_text_col, min_match, block_bytes):

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, item_type=item_type) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_leaks_in(batch.column(1), sent.value, min_match, coverage))
                columns = list(zip(*found, strict=True)) or [[], [], [], [], []]
                kinds = (item_type, pa.float64(), pa.int32(), pa.int32())
                own = batch.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, columns[1:], kinds)], [f.name for f in schema])

        found = rows.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, min_match: int, block_bytes: int) -> Iterator[tuple[Broadcast, pa.DataType]]:
    """The seed index of each block of the benchmark, sent to the workers, and the type of an item's id."""
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_t")).where("_t <> ''")
    size = items.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("_item", "_t"), F.lit(blocks)) == block).toArrow().combine_chunks()
        index = seed_index(own.column(0).to_pylist(), own.column(1), min_match)
        yield benchmark.sparkSession.sparkContext.broadcast(index), own.schema.field(0).type


def _leaks_in(texts: pa.Array, index: SeedIndex, min_match: int, coverage: float) -> Iterator[tuple[int, object, float, int, int]]:
    """(row, item, share covered, tiles, words) of each item that one of the texts leaks."""
    for first, offsets, hashes in word_hashes(texts):
        for row, item, starts, length in index.items_at(hashes, offsets, coverage):
            words = index.words[item]
            doc = _covered(starts, length, hashes, row)
            if len(doc) < coverage * len(words):
                continue
            tiles = greedy_tiles(doc, words, min(min_match, len(words)))
            marked = sum(n for n, _, _ in tiles)
            if marked >= coverage * len(words):
                yield first + row, index.ids[item], marked / len(words), len(tiles), marked


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item (see ``leaks``). Rows are judged one by one in the tasks that
    read them, whatever their ids; the blocks of the benchmark filter in turn, in one scan."""
    for sent, _ in _blocks(benchmark, item_col, item_text_col, min_match, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[row for row, *_ in _leaks_in(batch.column(text_col), sent.value, min_match, coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document id that leaks an item: id, ``contaminated``, ``covered`` (the largest share) and
    ``items`` (the leaked items, in order, with their shares and tiles)."""
    found = leaks(docs, benchmark, id_col, **options)
    item_col = options.get("item_col", "item_id")
    return found.groupBy(id_col).agg(
        F.lit(True).alias("contaminated"),
        F.max("covered").alias("covered"),
        F.array_sort(F.collect_set(F.struct(item_col, "covered", "tiles"))).alias("items"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
