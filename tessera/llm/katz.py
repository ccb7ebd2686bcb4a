"""Operator 3: Katz backoff language model, trained and evaluated in partitioned tables.

A word's probability after a word is its Good-Turing discounted relative frequency if the pair was seen,
else the backoff weight of the first word times the probability of the second alone, which in turn is
discounted if seen and shares the unseen mass if not. Weights are computed so that each history sums to 1.

All words and pairs of the training texts are in the model. What is kept of the most frequent words
(``shortlist``, at most that many, whatever the corpus) is broadcast, which saves sending it and changes no
result; they are told by numbers, all other words by their 64-bit hashes. Pairs of two listed words are dealt
by the first, and a very frequent one over several partitions by the second. A pair with an unlisted second
word stands in that word's partition, where its count is known too, and a pair with an unlisted first word
(also) in that one's, with its backoff weight: so each term of a probability is found in one place. Tokens
travel to the tables as sorted, packed arrays rather than rows; partial sums return packed by slice. Tokens of a pair that
makes up more than one in HEAD of all (so there are fewer than HEAD of them) don't travel: their counts are broadcast
too, and the task that reads them scores them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import checkpointed, mix, shared_folder, word_hashes
from tessera.session import table

SHORTLIST = 1 << 18
#: Good-Turing discounts apply to counts up to this; larger counts are taken as reliable.
RELIABLE = 5
#: A pair of more than one in so many tokens is scored where it is read.
HEAD = 1 << 17
#: Tokens packed together, and (about) tokens to one partition of the tables.
SLICE_TOKENS, PART_TOKENS = 400_000, 1_000_000
#: Folders of a stored table, however many partitions it has.
FOLDERS = 256
END = np.uint64(0x9D39247E33776D41)
RARE, BEGIN, FIRST = 0, 1, 2  # class numbers: all that is not listed, the start of a text, then the shortlist
_WIDTH = np.uint64(20)
LISTED = np.uint64(1 << 20)  # codes below are class numbers, others are hashes


# --- packed arrays -----------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that the codec of the shuffle finds the empty ones."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _pack(keys: np.ndarray, values: np.ndarray) -> dict[str, bytes]:
    """Ascending keys as differences, and one uint32 for each."""
    return {"keys": _planes(np.diff(keys, prepend=np.uint64(0))), "vals": _planes(values.astype(np.uint32))}


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def _pack_pairs(keys: np.ndarray, others: np.ndarray, values: np.ndarray) -> dict[str, bytes]:
    """Ascending keys as differences, and a code and one uint32 for each."""
    return {"keys": _planes(np.diff(keys, prepend=np.uint64(0))), "vals": _planes(others) + _planes(values.astype(np.uint32))}


def _pairs_of(keys: bytes, vals: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _keys(keys), _unplanes(vals[: len(keys)], np.uint64), _unplanes(vals[len(keys) :], np.uint32).astype(np.int64)


def _summed_pairs(keys: np.ndarray, others: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order with the sums of their counts."""
    if not len(keys):
        return keys, others, counts
    order = np.lexsort((others, keys))
    keys, others, counts = keys[order], others[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])]))
    return keys[at], others[at], np.add.reduceat(counts, at)


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key its place in an ascending table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class _PairTable:
    """Counts of distinct pairs in order, by both parts, and of their keys alone."""

    def __init__(self, keys: np.ndarray, others: np.ndarray, counts: np.ndarray):
        self.keys, self.others, self.n = np.unique(keys), np.unique(others), counts
        self.both = self._code(np.searchsorted(self.keys, keys), np.searchsorted(self.others, others))
        self.of_key = np.bincount(np.searchsorted(self.keys, keys), counts, len(self.keys)).astype(np.int64)

    @staticmethod
    def _code(key: np.ndarray, other: np.ndarray) -> np.ndarray:
        return key.astype(np.uint64) << np.uint64(32) | other.astype(np.uint64)

    def count(self, keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the pairs, and of the keys."""
        if not len(self.n):
            return np.zeros((2, len(keys)), np.int64)
        (k, has_key), (o, has_other) = _found(self.keys, keys), _found(self.others, others)
        at, has = _found(self.both, self._code(k, o))
        return np.where(has & has_key & has_other, self.n[at], 0), np.where(has_key, self.of_key[k], 0)


# --- discounts ---------------------------------------------------------------------------------


def good_turing(of: dict[int, int]) -> np.ndarray:
    """Discounts of counts 0 to RELIABLE from the numbers of types seen r times.

    Katz' formula on the numbers as they are, where that gives discounts in (0, 1); else on numbers smoothed by a
    log-linear fit (simple Good-Turing), whose slope is kept under -1, as it must be. A fit of fewer than two numbers
    takes the slope -2.
    """
    n = np.array([0, *(of.get(r, 0) for r in range(1, RELIABLE + 2))], float)
    out = _katz(n)
    if out is None:
        r = np.flatnonzero(n)
        slope = min(np.polyfit(np.log(r), np.log(n[r]), 1)[0], -1.05) if len(r) > 1 else -2.0
        out = _katz(np.array([0.0, *(float(k) ** slope for k in range(1, RELIABLE + 2))]))
    return out


def _katz(n: np.ndarray) -> np.ndarray | None:
    """Katz' discounts, None where one of them is not in (0, 1)."""
    if not n[1:].all():
        return None
    top = (RELIABLE + 1) * n[RELIABLE + 1] / n[1]
    r = np.arange(1, RELIABLE + 1)
    out = ((r + 1) * n[2:] / (r * n[1:-1]) - top) / (1 - top) if top < 1 else np.zeros(RELIABLE)
    return np.concatenate([[1.0], out]) if ((out > 0) & (out < 1)).all() else None


def _discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= RELIABLE, discounts[np.minimum(counts, RELIABLE).astype(np.int64)], 1.0)


# --- the model ---------------------------------------------------------------------------------


@dataclass
class KatzModel:
    """Small arrays by class (bounded by the shortlist and BEGIN), and the paths of the partitioned tables."""

    words: np.ndarray  # hashes of the shortlist, ascending
    counts: np.ndarray  # their training counts
    total: int  # training tokens
    types: int  # distinct training tokens
    parts: int
    salt: np.ndarray  # by class: partitions its pairs are dealt over
    word_discounts: np.ndarray
    pair_discounts: np.ndarray
    alone: np.ndarray  # by class: probability without a history
    shrink: float  # factor of the other words' discounted frequencies
    unseen: float  # probability of the one unseen word type
    history: np.ndarray  # by class: tokens after it in training
    gain: np.ndarray  # by class: factor of the discounted frequencies
    back: np.ndarray  # by class: backoff weight
    head: np.ndarray  # keys of the very frequent pairs of listed words, ascending
    head_counts: np.ndarray
    pairs_path: str
    histories_path: str


def _slices(batches: Iterator[pa.RecordBatch], id_column: int, text_column: int):
    """(number, list of columns slices, token hashes, first token of each text): about SLICE_TOKENS each."""
    base, count = TaskContext.get().partitionId() << 24, 0
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for first, offsets, hashes in word_hashes(batch.column(text_column)):
            rows = len(offsets) - 1
            row = np.repeat(np.arange(rows), np.diff(offsets))
            tokens = np.full(len(hashes) + rows, END)
            tokens[np.arange(len(hashes)) + row] = hashes
            held.append((batch.slice(first, rows), tokens, offsets + np.arange(rows + 1)))
            size += len(tokens)
            if size >= SLICE_TOKENS:
                yield base + count, *_joined(held)
                held, size, count = [], 0, count + 1
    if held:
        yield base + count, *_joined(held)


def _joined(held):
    shift = np.cumsum([0, *(len(t) for _, t, _ in held)])
    begins = np.concatenate([o[:-1] + s for (_, _, o), s in zip(held, shift, strict=False)])
    return pa.Table.from_batches([b for b, _, _ in held]), np.concatenate([t for _, t, _ in held]), begins


def _codes(tokens: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Class numbers of listed words, else the hashes."""
    at, listed = _found(words, tokens)
    return np.where(listed, (at + FIRST).astype(np.uint64), tokens)


def _before(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[begins] = BEGIN
    return before


def _word_part(codes: np.ndarray, parts: int) -> np.ndarray:
    return codes.view(np.int64) % np.int64(parts)  # as pmod


def _unlisted(before: np.ndarray, codes: np.ndarray):
    """(kind, places, keys, others) of the pairs that are dealt by an unlisted word, second or first."""
    for kind, key, other in (("second", codes, before), ("first", before, codes)):
        at = np.flatnonzero(key >= LISTED)
        yield kind, at, key[at], other[at]


def _weights(n: np.ndarray, kept: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the discounted frequencies and backoff weights of histories seen ``n`` times."""
    seen = np.maximum(n, 1)
    left = 1 - after  # probability, without a history, of what was not seen after this one
    full = left <= 1e-9
    # a history whose counts are all reliable keeps nothing back: its denominator grows by one, as is usual
    reserve = np.where(full, 0.0, np.where(kept < seen - 1e-9, 1 - kept / seen, 1 / (seen + 1)))
    gain = np.where(n > 0, (1 - reserve) / np.maximum(kept / seen, 1e-300), 0.0)
    return gain, np.where(n > 0, reserve / np.where(full, 1.0, left), 1.0)


def _part_of(before: np.ndarray, classes: np.ndarray, salt: np.ndarray, parts: int) -> np.ndarray:
    spread = mix(classes + np.uint64(77)) % salt[before.astype(np.int64)]
    return ((mix(before) + spread) % np.uint64(parts)).astype(np.int64)


def _dealt(part: np.ndarray, keys: np.ndarray, *then: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, indices in key order) of each partition that has any."""
    order = np.lexsort((*then, keys, part))
    cut = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cut):
        if len(own):
            yield int(part[own[0]]), own


_PACKED = "part int, kind string, slice long, keys binary, vals binary"


def _squeezed(raw: bytes) -> bytes:
    """Its length and the bytes under zstd, which makes use of half-filled bytes, as the shuffle's codec doesn't."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else raw


def _plain(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True) if raw else raw


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([r | {c: _squeezed(r[c]) for c in ("keys", "vals")} for r in rows], schema)


def _opened(row: dict) -> dict:
    return row | {c: _plain(row[c]) for c in ("keys", "vals")}


_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("slice", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])


def _store(df: DataFrame, name: str) -> str:
    """Writes a table, its parts dealt over at most FOLDERS folders, to the shared folder and returns its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/katz-{uuid.uuid4().hex}/{name}"
    df.withColumn("folder", F.pmod("part", F.lit(FOLDERS))).write.partitionBy("folder").parquet(path)
    return path


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, keys binary, vals binary, part int, folder int").parquet(path).drop("folder")


def train(texts: DataFrame, text_col: str, shortlist: int = SHORTLIST, head: int = HEAD) -> KatzModel:
    """Counts words and pairs over all the texts and normalises the backoff weights."""
    spark = texts.sparkSession

    def count_words(batches):
        for _, _, tokens, _ in _slices(batches, 0, 0):
            word, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["w", "c"])

    counted = texts.select(text_col).mapInArrow(count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    words = checkpointed(counted)
    # counts by level: exact up to RELIABLE + 1, then sixteen levels to a doubling
    level = F.when(F.col("c") <= RELIABLE + 1, F.col("c").cast("double")).otherwise(100 + F.floor(16 * F.log2("c")))
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("c").alias("tokens"), F.min("c").alias("least"))
    levels = sorted(levels.collect(), key=lambda r: -r["least"])
    total, types = sum(r["tokens"] for r in levels), sum(r["types"] for r in levels)
    least, listed = 1 << 62, 0
    for r in levels:
        if listed + r["types"] > shortlist:
            break
        least, listed = r["least"], listed + r["types"]
    most = words.where(F.col("c") >= least).toPandas()
    hashes, own = most["w"].to_numpy(np.int64).view(np.uint64), most["c"].to_numpy(np.int64)
    order = np.argsort(hashes)
    hashes, own = hashes[order], own[order]
    parts = max(1, math.ceil(total / PART_TOKENS))
    by_class = np.concatenate([[max(0, total - own.sum()), 0], own]).astype(np.float64)
    salt = np.clip(np.ceil(by_class * parts * 4 / max(1, total)), 1, parts).astype(np.uint64)
    salt[BEGIN] = parts

    word_discounts = good_turing({int(r["least"]): int(r["types"]) for r in levels if r["least"] <= RELIABLE + 1})
    lost = sum(r["tokens"] * (1 - word_discounts[r["least"]]) for r in levels if r["least"] <= RELIABLE)
    shrink = 1.0 if lost >= 1 else 1 - 1 / max(total, 1)  # where hardly any count is discounted
    unseen = 1 - shrink * (1 - lost / total) if total else 1.0
    alone = np.concatenate([[0.0, 0.0], shrink * _discounted(own, word_discounts) / max(total, 1)])
    alone[RARE] = max(0.0, 1 - alone.sum())

    def count_pairs(batches):
        for _, _, tokens, begins in _slices(batches, 0, 0):
            codes = _codes(tokens, listed_words.value)
            before = _before(codes, begins)
            both = (before < LISTED) & (codes < LISTED)
            keys, n = np.unique(before[both] << _WIDTH | codes[both], return_counts=True)
            part = _part_of(keys >> _WIDTH, keys & (LISTED - np.uint64(1)), salts.value, parts)
            rows = [{"part": p, "kind": "pairs", "slice": 0, **_pack(keys[i], n[i])} for p, i in _dealt(part, keys)]
            for kind, at, key, other in _unlisted(before, codes):
                key, other, n = _summed_pairs(key, other, np.ones(len(at), np.int64))
                rows += [{"part": p, "kind": kind, "slice": 0, **_pack_pairs(key[i], other[i], n[i])} for p, i in _dealt(_word_part(key, parts), key, other)]
            yield _rows(rows, _SCHEMA)

    def merge_pairs(group: pa.Table) -> pa.Table:
        rows, part = list(map(_opened, group.select(["kind", "keys", "vals"]).to_pylist())), group.column("part")[0].as_py()
        out = []
        for kind in ("pairs", "second", "first"):
            own = [r for r in rows if r["kind"] == kind]
            if own and kind == "pairs":
                n = np.concatenate([_unplanes(r["vals"], np.uint32) for r in own]).astype(np.int64)
                out.append({"part": part, "kind": kind, "slice": 0, **_pack(*_summed(np.concatenate([_keys(r["keys"]) for r in own]), n))})
            elif own:
                columns = map(np.concatenate, zip(*(_pairs_of(r["keys"], r["vals"]) for r in own), strict=True))
                out.append({"part": part, "kind": kind, "slice": 0, **_pack_pairs(*_summed_pairs(*columns))})
        return pa.Table.from_batches([_rows(out, _SCHEMA)])

    listed_words, salts = spark.sparkContext.broadcast(hashes), spark.sparkContext.broadcast(salt)
    pairs = texts.select(text_col).mapInArrow(count_pairs, _PACKED).groupBy("part").applyInArrow(merge_pairs, _PACKED)
    pairs_path = _store(pairs.select("kind", "keys", "vals", "part"), "pairs")

    def count_counts(batches):
        for batch in batches:
            n = np.zeros(RELIABLE + 2, np.int64)
            for kind, keys, vals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, vals = _plain(keys), _plain(vals)
                if kind == "pairs":
                    found = _unplanes(vals, np.uint32)
                else:
                    _, other, found = _pairs_of(keys, vals)
                    found = found if kind == "second" else found[other < LISTED]  # pairs of two unlisted words stand in both
                n += np.bincount(np.minimum(found, RELIABLE + 2), minlength=RELIABLE + 3)[: RELIABLE + 2]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["r", "types"])

    seen = _stored(spark, pairs_path).select("kind", "keys", "vals").mapInArrow(count_counts, "r long, types long")
    seen = {r["r"]: r["n"] for r in seen.groupBy("r").agg(F.sum("types").alias("n")).collect() if r["r"]}
    pair_discounts = good_turing(seen)

    def frequent(batches):
        for batch in batches:
            for kind, keys, vals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "pairs":
                    key, n = _keys(_plain(keys)), _unplanes(_plain(vals), np.uint32).astype(np.int64)
                    top = n * head > total
                    yield pa.RecordBatch.from_arrays([pa.array(key[top].view(np.int64)), pa.array(n[top])], ["k", "n"])

    very = _stored(spark, pairs_path).select("kind", "keys", "vals").mapInArrow(frequent, "k long, n long").toPandas()  # fewer than ``head`` rows
    order = np.argsort(very["k"].to_numpy(np.int64).view(np.uint64))
    head_keys, head_counts = very["k"].to_numpy(np.int64).view(np.uint64)[order], very["n"].to_numpy(np.int64)[order]
    probabilities = spark.sparkContext.broadcast(alone)

    def histories(batches):
        for batch in batches:
            for kind, raw, vals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, vals = _plain(raw), _plain(vals)
                if kind == "pairs":
                    keys, n = _keys(raw), _unplanes(vals, np.uint32).astype(np.int64)
                    before, after = keys >> _WIDTH, probabilities.value[(keys & (LISTED - np.uint64(1))).astype(np.int64)]
                elif kind == "second":
                    word, before, n = _pairs_of(raw, vals)
                    own = _PairTable(word, before, n).count(word, before)[1]  # each token of the word has one pair
                    after = shrink * _discounted(own, word_discounts) / total
                    n = np.where(before < LISTED, n, 0)  # else "first" has it
                else:
                    before, word, n = _pairs_of(raw, vals)
                    after = np.where(word < LISTED, probabilities.value[np.where(word < LISTED, word, 0).astype(np.int64)], 0.0)
                order = np.argsort(before, kind="stable")
                before = before[order]
                at = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(before) else np.zeros(0, np.int64)
                sums = [np.add.reduceat(x[order], at) if len(at) else np.zeros(0) for x in (n.astype(float), _discounted(n, pair_discounts), after)]
                yield pa.RecordBatch.from_arrays([pa.array(before[at].view(np.int64)), *map(pa.array, sums)], ["h", "n", "kept", "after"])

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("h").to_numpy().view(np.uint64))
        n, kept, after = (group.column(c).to_numpy()[order] for c in ("n", "kept", "after"))
        gain, back = _weights(n, kept, after)
        keys = group.column("h").to_numpy().view(np.uint64)[order]
        row = {"part": group.column("part")[0].as_py(), "kind": "histories", "slice": 0, "keys": _planes(np.diff(keys, prepend=np.uint64(0)))}
        return pa.Table.from_batches([_rows([row | {"vals": np.concatenate([gain / np.maximum(n, 1), back]).tobytes()}], _SCHEMA)])

    sums = _stored(spark, pairs_path).select("kind", "keys", "vals").mapInArrow(histories, "h long, n double, kept double, after double")
    sums = checkpointed(sums.groupBy("h").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"), F.sum("after").alias("after")))
    of_list = F.col("h").between(0, int(LISTED) - 1)
    others = sums.where(~of_list).withColumn("part", F.pmod(F.col("h"), F.lit(parts)).cast("int"))
    histories_path = _store(others.groupBy("part").applyInArrow(pack, _PACKED).select("kind", "keys", "vals", "part"), "histories")
    listed_sums = sums.where(of_list).toPandas()
    history, kept, after = (np.zeros(len(alone)) for _ in range(3))
    for out, name in ((history, "n"), (kept, "kept"), (after, "after")):
        out[listed_sums["h"].to_numpy(np.int64)] = listed_sums[name].to_numpy(float)
    gain, back = _weights(history, kept, after)
    return KatzModel(
        hashes, own, int(total), int(types), parts, salt, word_discounts, pair_discounts, alone, float(shrink), float(unseen),
        history, gain, back, head_keys, head_counts, pairs_path, histories_path,
    )


def score(texts: DataFrame, model: KatzModel, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``n_known``, ``base_score`` and ``score``."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model)
    id_type = texts.schema[id_col].dataType
    id_schema = pa.schema([texts.select(id_col).limit(0).toArrow().schema.field(0).with_name("id")])

    def deal(batches):
        m = sent.value
        log_floor = math.log10(m.total + m.types + 1)
        for number, held, tokens, begins in _slices(batches, 0, 1):
            codes = _codes(tokens, m.words)
            before = _before(codes, begins)
            doc = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(tokens))))
            listed = codes < LISTED
            known = np.where(listed, codes - np.uint64(FIRST), 0).astype(np.int64)
            count = m.counts[known] if len(m.counts) else np.zeros(len(tokens))
            base = np.where(listed, np.log10(count + 1) - log_floor, 0.0)
            sink = pa.BufferOutputStream()
            ids = held.select([0]).rename_columns(["id"]).cast(id_schema)
            with pa.ipc.new_stream(sink, ids.schema) as out:
                out.write_table(ids)
            both = np.flatnonzero(listed & (before < LISTED))
            keys = before[both] << _WIDTH | codes[both]
            at, here = _found(m.head, keys)
            own = np.zeros(len(tokens))  # scores of the very frequent pairs
            if here.any():
                h, n = (keys[here] >> _WIDTH).astype(np.int64), m.head_counts[at[here]]
                own[both[here]] = np.log10(m.gain[h] / np.maximum(m.history[h], 1) * _discounted(n, m.pair_discounts))
            both, keys = both[~here], keys[~here]
            facts = np.stack([np.bincount(doc, x, len(begins)) for x in (None, listed, base, own)])
            yield _rows([{"part": number % m.parts, "kind": "documents", "slice": number, "keys": sink.getvalue().to_pybytes(), "vals": facts.astype(float).tobytes()}], _SCHEMA)
            for p, own in _dealt(_part_of(before[both], codes[both], m.salt, m.parts), keys):
                yield _rows([{"part": p, "kind": "tokens", "slice": number, **_pack(keys[own], doc[both[own]])}], _SCHEMA)
            for kind, at, key, other in _unlisted(before, codes):
                for p, own in _dealt(_word_part(key, m.parts), key, other):
                    yield _rows([{"part": p, "kind": f"{kind} tokens", "slice": number, **_pack_pairs(key[own], other[own], doc[at[own]])}], _SCHEMA)

    def evaluate(group: pa.Table) -> pa.Table:
        m = sent.value
        log_floor = math.log10(m.total + m.types + 1)
        rows = group.to_pylist()
        stored = {r["kind"]: _opened(r) for r in rows if r["kind"] in ("pairs", "second", "first", "histories")}
        none = {"keys": b"", "vals": b""}
        raw = stored.get("pairs", none)
        pairs, counts = _keys(raw["keys"]), _unplanes(raw["vals"], np.uint32).astype(np.int64)
        tables = {kind: _PairTable(*_pairs_of(*(stored.get(kind, none)[c] for c in ("keys", "vals")))) for kind in ("second", "first")}
        raw = stored.get("histories", none)
        first, (share, weight) = _keys(raw["keys"]), np.frombuffer(raw["vals"]).reshape(2, -1)
        with np.errstate(divide="ignore"):
            log_back, log_alone = np.log10(m.back), np.log10(m.alone)

        def terms(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(document, known, base, score) of each token of a row."""
            r = _opened(r)
            if r["kind"] == "tokens":
                keys, doc = _keys(r["keys"]), _unplanes(r["vals"], np.uint32)
                at, has = _found(pairs, keys)
                n = np.where(has, counts[at], 0) if len(pairs) else np.zeros(len(keys), np.int64)
                h, w = (keys >> _WIDTH).astype(np.int64), (keys & (LISTED - np.uint64(1))).astype(np.int64)
                factor, missed = m.gain[h] / np.maximum(m.history[h], 1), log_back[h] + log_alone[w]
                hits = np.log10(np.where(n > 0, factor * _discounted(n, m.pair_discounts), 1.0))
                return doc, np.zeros(len(doc)), np.zeros(len(doc)), np.where(n > 0, hits, missed)
            key, other, doc = _pairs_of(r["keys"], r["vals"])
            n, own = tables[r["kind"].split()[0]].count(key, other)
            listed = other < LISTED
            number = np.where(listed, other, 0).astype(np.int64)
            if r["kind"] == "second tokens":  # of an unlisted history, "first tokens" has the rest
                p = np.where(own > 0, m.shrink * _discounted(own, m.word_discounts) / max(m.total, 1), m.unseen)
                factor = m.gain[number] / np.maximum(m.history[number], 1)
                missed = np.where(listed, log_back[number], 0.0) + np.log10(p)
                known, base = (own > 0).astype(float), np.log10(own + 1) - log_floor
            else:
                at, has = _found(first, key)
                factor, back = (np.where(has, x[at], 1.0) if len(first) else np.ones(len(key)) for x in (share, weight))
                with np.errstate(divide="ignore"):
                    missed = np.log10(back) + np.where(listed, log_alone[number], 0.0)
                known = base = np.zeros(len(doc))
                listed = np.ones(len(key), bool)
            hits = np.log10(np.where((n > 0) & listed, factor * _discounted(n, m.pair_discounts), 1.0))
            return doc, known, base, np.where(n > 0, hits, missed)

        out, slices = [], {}
        for r in rows:
            if r["kind"] == "documents":
                out.append({"slice": r["slice"], "ids": r["keys"], "sums": r["vals"]})
            elif r["kind"].endswith("tokens"):
                slices.setdefault(r["slice"], []).append(r)
        for number, own in slices.items():  # one row a slice, of the documents that have tokens here
            doc, *columns = map(np.concatenate, zip(*map(terms, own), strict=True))
            docs, place = np.unique(doc, return_inverse=True)
            known, base, total = (np.bincount(place, x, len(docs)) for x in columns)
            out.append({"slice": number, "ids": None, "sums": _squeezed(_planes(docs.astype(np.uint32)) + _planes(known.astype(np.uint32)) + base.tobytes() + total.tobytes())})
        return pa.Table.from_pylist(out, pa.schema([("slice", pa.int64()), ("ids", pa.binary()), ("sums", pa.binary())]))

    result = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    )

    def total(group: pa.Table) -> pa.Table:
        rows = [r | {"sums": _plain(r["sums"])} for r in group.to_pylist()]
        head = next(r for r in rows if r["ids"] is not None)
        ids = pa.ipc.open_stream(_plain(head["ids"])).read_all().column(0)
        tokens, *facts = np.frombuffer(head["sums"]).reshape(4, -1)
        sums = np.stack(facts)
        for r in sorted((r for r in rows if r["ids"] is None), key=lambda r: r["sums"]):  # one order, whoever came first
            n = len(r["sums"]) // 24
            docs, known = (_unplanes(r["sums"][k * n : (k + 4) * n], np.uint32) for k in (0, 4))
            sums[:, docs] += np.stack([known, *np.frombuffer(r["sums"][8 * n :]).reshape(2, -1)])
        return pa.table(
            {id_col: ids, "n_tokens": tokens.astype(np.int64), "n_known": np.rint(sums[0]).astype(np.int64), "base_score": sums[1], "score": sums[2]}
        )

    dealt = texts.select(id_col, text_col).mapInArrow(deal, _PACKED)
    for path in (model.pairs_path, model.histories_path):
        dealt = dealt.unionByName(_stored(spark, path).withColumn("slice", F.lit(0).cast("long")))
    partial = dealt.groupBy("part").applyInArrow(evaluate, "slice long, ids binary, sums binary")
    return partial.groupBy("slice").applyInArrow(total, result)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortlist: int = SHORTLIST, head: int = HEAD) -> DataFrame:
    """Trains on the documents that are not held out and scores all: id, ``held_out``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` (add-one unigram), ``score`` (Katz, log10).

    Tokens are words between white space, lower-cased A-Z, and one end for each text; a null or empty text
    is its end alone. Texts are read whole, repeated rows all count, a null id is a training row, other
    columns are ignored. Without any training row every word is the one unseen type. ``shortlist`` and ``head`` change no result.
    """
    model = train(docs.where(~held_out(id_col)), text_col, shortlist, head)
    return score(docs, model, id_col, text_col).select(
        id_col, held_out(id_col).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))
