"""Helpers of the corpus operators: checkpoints, key filters, text normalisation and word hashes of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import durable, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes hashed at once; numpy temporaries stay in cache and memory stays bounded.
SLICE_BYTES = 1 << 20

#: Bits of the bitmap behind ``maybe_among``: 8 MB, whatever the size of the input.
FILTER_BITS = 1 << 26
checkpointed = durable


def marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``__maybe``: false if the key is surely not among the ``wanted`` ones (a column of that name).

    The wanted keys set bits of one bitmap, which Spark builds and broadcasts. Its size is fixed; the more keys
    it holds, the more other rows pass, so an exact join of what passes must follow.
    """
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    places = wanted.select(at.alias("__at")).select(F.bitmap_bucket_number("__at").alias("__bucket"), F.bitmap_bit_position("__at").alias("__bit"))
    bits = places.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))  # 2,048 rows at most
    both = rows.withColumn("__at", at).withColumn("__bucket", F.bitmap_bucket_number("__at")).join(F.broadcast(bits), "__bucket", "left")
    byte = F.expr("int(conv(hex(substring(__bits, int(bitmap_bit_position(__at) div 8) + 1, 1)), 16, 10))")
    bit = F.expr("int(bitmap_bit_position(__at) % 8)")
    both = both.withColumn("__byte", F.coalesce(byte, F.lit(0))).withColumn("__bit", bit)
    return both.withColumn("__maybe", F.expr("shiftright(__byte, __bit) % 2 = 1")).drop("__at", "__bucket", "__bits", "__byte", "__bit")


def maybe_among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows that ``marked`` lets pass: all whose key is wanted, and few others."""
    return marked(rows, key, wanted).where("__maybe").drop("__maybe")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the JVM's fast path, which then does the same."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- word hashes -------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C13 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_pow: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _pow or len(_pow["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        _pow["up"], _pow["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, down) such that ``(total[j] - total[i]) * down[i]`` hashes ``data[i:j]`` wherever it stands."""
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total, down


def hash_slice(data: np.ndarray, starts: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of ``data`` in order and each word's byte position; no word crosses ``starts``."""
    word = ~space[data]
    begin = np.empty(len(data), bool)
    begin[0], begin[1:] = True, ~word[:-1]
    cut = starts[starts < len(data)]
    begin[cut] = True
    end = np.empty(len(data), bool)
    end[-1], end[:-1] = True, begin[1:] | ~word[1:]
    first, last = np.flatnonzero(word & begin), np.flatnonzero(word & end) + 1
    total, down = prefix_sums(data)
    return mix((total[last] - total[first]) * down[first]), first


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying; null counts as empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    raw = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def row_slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_BYTES; a longer row is a run of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, stop
        row = stop


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, offsets, hashes) for runs of rows: row ``first + i`` of the column has the word
    hashes ``hashes[offsets[i]:offsets[i + 1]]``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; equal words have equal 64-bit hashes. A text
    longer than ``SLICE_BYTES`` is hashed in pieces cut at white space, so temporaries stay small.
    """
    offsets, data = text_buffers(column)
    for row, stop in row_slices(offsets):
        begin, end = int(offsets[row]), int(offsets[stop])
        if begin == end:
            yield row, np.zeros(stop - row + 1, np.int64), np.zeros(0, np.uint64)
        elif stop - row == 1 and end - begin > SLICE_BYTES:
            found = [hash_slice(piece, np.zeros(1, np.int64))[0] for piece in pieces_at(data[begin:end])]
            hashes = np.concatenate(found)
            yield row, np.array([0, len(hashes)], np.int64), hashes
        else:
            starts = offsets[row : stop + 1] - begin
            hashes, at = hash_slice(data[begin:end], starts)
            yield row, np.searchsorted(at, starts), hashes


def pieces_at(data: np.ndarray, ends: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """Pieces of about SLICE_BYTES that end behind a byte of ``ends``, or wherever the next one is."""
    at = 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data):
            spaces = np.flatnonzero(ends[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
                break
            end = min(end + SLICE_BYTES, len(data))
        yield data[at:end]
        at = end


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive words (none if there are fewer)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[k : k + size]
    return mix(out)


def token_windows(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` tokens, rolled along in one pass whatever ``n`` is."""
    up, down = _tables(len(tokens) + 1)
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up[: len(tokens)], out=total[1:])
    size = max(0, len(tokens) - n + 1)
    return (total[n : n + size] - total[:size]) * down[:size]


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingles of ``n`` words; a shorter text is one shingle, an empty one none."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(grams(hashes, min(n, len(hashes))))
