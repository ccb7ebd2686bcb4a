"""Operator 13: packing of documents into training sequences by a grouping genetic algorithm.

A packing is an individual and its sequences are the genes. Crossover injects whole well-filled sequences of one
parent into the other, removes the other's sequences that hold an injected piece, and best-fits the pieces that
this displaces, after these have taken the places of shorter ones where they fill a sequence better. Pieces are dealt by hash to blocks of bounded size. Each block is packed by several islands, tasks of
their own, which send their elite to the next island of the block between epochs. Then sequences
with room left are dealt anew, whole, to blocks with others, and evolve again; the old packing is among
the first individuals there, so that no round loses ground.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import delete, stored, table

CAPACITY = 2048
#: Pieces of a block on average.
PIECES = 4096
ISLANDS, EPOCHS, ROUNDS = 4, 3, 3
#: Packings of an island, and offspring that an island has in an epoch.
POPULATION, OFFSPRING = 4, 10
END = 0


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


# --- tokens ------------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file. Its ids are in the order of its merges, so that they serve as ranks."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): k for token, k in said["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, path: str) -> np.ndarray:
    return encoder(path).encode_to_numpy(text, allowed_special="all")


def cuts(size: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of a document begin, and its end: pieces of the capacity, the first one may be shorter."""
    first = size if size <= capacity else size % capacity or capacity
    return [0, *range(first, size + 1, capacity)]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """row (a number for each piece), id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, at, out = batch.column(1), [], []
            for i in range(batch.num_rows):
                ids = np.append(token_ids(texts[i].as_py() or "", path), np.uint32(END)).astype("<u4")
                marks = cuts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False)):
                    at.append(i)
                    out.append((count, k, a, b - a, zlib.crc32(ids[a:b])))
                    count += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else None
            if columns:
                columns.insert(1, batch.column(0).take(pa.array(at)))
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"row long, id {kind}, piece int, start long, length long, ids_crc32 long")


# --- one packing -------------------------------------------------------------------------------------


def _numbered(bins: np.ndarray) -> np.ndarray:
    """Sequence numbers from 0 without gaps; -1 (not placed) stays."""
    names, own = np.unique(bins, return_inverse=True)
    return own - (len(names) > 0 and names[0] < 0)


def best_fit(lengths: np.ndarray, bins: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Places the pieces of ``order`` one by one into the fullest sequence that holds them, else into a new one."""
    bins = _numbered(bins)
    room = capacity - np.bincount(bins[bins >= 0], lengths[bins >= 0], minlength=bins.max(initial=-1) + 1).astype(np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for k, r in enumerate(room.tolist()):
        by_room[r].append(k)
    for r in set(room.tolist()):
        bits |= 1 << r
    count = len(room)
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = bits >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                bits &= ~(1 << r)
        else:
            r, k, count = capacity, count, count + 1
        bins[i] = k
        by_room[r - size].append(k)
        bits |= 1 << (r - size)
    return bins


def worth(lengths: np.ndarray, bins: np.ndarray) -> tuple[int, int]:
    """Less is better: the number of sequences, then minus the sum of squares of what they hold."""
    fill = np.bincount(bins, lengths).astype(np.int64)
    return len(fill), -int((fill * fill).sum())


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Injects well-filled sequences of ``a``, any half of its fuller half, into ``b``."""
    fill = np.bincount(a, lengths)
    taken = (fill >= np.median(fill)) & (rng.random(len(fill)) < 0.5)
    injected = taken[a]
    broken = np.zeros(b.max() + 1, bool)
    broken[b[injected]] = True
    child = np.where(injected, a, np.where(broken[b], -1, b + len(fill)))
    return _placed(lengths, child, capacity, rng)


def mutated(lengths: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Opens the emptiest sequences and some others and places their pieces anew."""
    fill = np.bincount(bins, lengths)
    opened = rng.random(len(fill)) < 0.05
    opened[np.argsort(fill + rng.random(len(fill)) * 64)[: max(1, len(fill) // 20)]] = True
    return _placed(lengths, np.where(opened[bins], -1, bins), capacity, rng)


def exchanged(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Fills sequences up: a loose piece takes the place of one or two shorter ones, which become loose, where it fits and
    leaves less room. Loose pieces get shorter by that, so that the rest is easier to place."""
    bins = _numbered(bins)
    loose = sorted((int(lengths[i]), int(i)) for i in np.flatnonzero(bins < 0))
    if not loose:
        return bins
    fill = np.bincount(bins[bins >= 0], lengths[bins >= 0], minlength=bins.max() + 1).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    starts = np.searchsorted(bins[order], np.arange(len(fill) + 1))
    for k in np.flatnonzero(fill < capacity).tolist():
        own = [(int(lengths[i]), int(i)) for i in order[starts[k] : starts[k + 1]]]
        room, best = capacity - int(fill[k]), (0, ())
        for some in (*((x,) for x in own), *combinations(own, 2)):
            size = sum(n for n, _ in some)
            at = bisect_right(loose, (size + room, len(lengths))) - 1
            if at >= 0 and loose[at][0] - size > best[0]:
                best = loose[at][0] - size, (at, some)
        if best[1]:
            at, some = best[1]
            bins[loose.pop(at)[1]] = k
            for piece in some:
                bins[piece[1]] = -1
                insort(loose, piece)
    return bins


def _placed(lengths: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    bins = exchanged(lengths, bins, capacity)
    loose = np.flatnonzero(bins < 0)
    noise = rng.random(len(loose)) * rng.choice([1e-3, 0.02, 0.1]) + 1
    return best_fit(lengths, bins, loose[np.argsort(-lengths[loose] * noise, kind="stable")], capacity)


def evolved(lengths: np.ndarray, packings: list[np.ndarray], capacity: int, offspring: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after so many offspring, best first; each takes the place of the worst packing if it is better."""
    ranked = sorted(((worth(lengths, p), k, p) for k, p in enumerate(packings)), key=lambda x: x[:2])
    least = math.ceil(int(lengths.sum()) / capacity)
    for k in range(offspring):
        if ranked[0][0][0] <= least or len(lengths) < 2:
            break
        one, two = (ranked[min(rng.integers(len(ranked), size=2))][2] for _ in range(2))  # tournaments of two
        child = crossover(lengths, one, two, capacity, rng)
        if rng.random() < 0.5 or worth(lengths, child) == ranked[0][0]:
            child = mutated(lengths, child, capacity, rng)
        own = worth(lengths, child)
        if own < ranked[-1][0] and own not in [w for w, _, _ in ranked]:
            ranked[-1] = (own, len(packings) + k, child)
            ranked.sort(key=lambda x: x[:2])
    return [p for _, _, p in ranked]


# --- islands -----------------------------------------------------------------------------------------

_PLACED = "row long, length long, sequence_id long, offset long, fill long"
_STATE = "block long, island int, rows binary, lengths binary, packings binary"


def _state(block: int, island: int, rows: np.ndarray, lengths: np.ndarray, packings: list[np.ndarray]) -> dict:
    return {
        "block": block, "island": island, "rows": rows.astype("<i8").tobytes(), "lengths": lengths.astype("<i8").tobytes(),
        "packings": np.array(packings, "<i4").tobytes(),
    }


def _read(state) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    rows, lengths = (np.frombuffer(state[c], "<i8") for c in ("rows", "lengths"))
    return rows, lengths, list(np.frombuffer(state["packings"], "<i4").reshape(-1, len(rows)).astype(np.int64))


def _rng(*seeds: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([s & 0xFFFFFFFF for s in seeds]))


def packed_blocks(dealt: DataFrame, capacity: int, turn: int) -> DataFrame:
    """row, length, sequence_id (its smallest row), offset, fill: the best packing of each block (row, length, bin or null, block)."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        block, rows, lengths = int(group["block"].iloc[0]), group["row"].to_numpy(), group["length"].to_numpy()
        falling = np.argsort(-lengths, kind="stable")
        none = np.full(len(rows), -1)
        first = [best_fit(lengths, none, falling, capacity)]
        if not group["bin"].isna().any():
            first.append(_numbered(group["bin"].to_numpy(np.int64)))
        out = []
        for island in range(ISLANDS):
            rng = _rng(turn, block, island)
            more = [_placed(lengths, none, capacity, rng) for _ in range(POPULATION - len(first))]
            out.append(_state(block, island, rows, lengths, first + more))
        return pd.DataFrame(out)

    def evolve(epoch: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            block, island = int(group["block"].iloc[0]), int(group["island"].iloc[0])
            states = [_read(s) for _, s in group.iterrows()]
            rows, lengths, _ = states[0]
            everyone = sorted((worth(lengths, p), p.tobytes()) for _, _, own in states for p in own)
            survivors = [np.frombuffer(p, np.int64) for _, p in everyone[:POPULATION]]
            return pd.DataFrame([_state(block, island, rows, lengths, evolved(lengths, survivors, capacity, OFFSPRING, _rng(turn, block, island, epoch)))])

        return run

    def elite(group: pd.DataFrame) -> pd.DataFrame:
        states = [_read(s) for _, s in group.iterrows()]
        rows, lengths, _ = states[0]
        best = min((worth(lengths, own[0]), own[0].tobytes()) for _, _, own in states)[1]
        bins = np.frombuffer(best, np.int64)
        order = np.argsort(bins, kind="stable")  # rows ascend within a sequence
        heads = np.searchsorted(bins[order], np.arange(bins.max() + 1))
        before = np.cumsum(lengths[order]) - lengths[order]
        own = bins[order]
        columns = {"row": rows[order], "length": lengths[order], "sequence_id": rows[order][heads][own], "offset": before - before[heads][own]}
        return pd.DataFrame(columns | {"fill": np.bincount(bins, lengths)[own].astype(np.int64)})

    states = stored(dealt.groupBy("block").applyInPandas(settle, _STATE))
    for epoch in range(EPOCHS):
        both = states
        if epoch:
            one = F.expr("substring(packings, 1, int(octet_length(rows) div 2))")  # the best packing, four bytes a piece
            both = both.union(states.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")).withColumn("packings", one))
        states = stored(both.groupBy("block", "island").applyInPandas(evolve(epoch), _STATE), replaces=states)
    out = stored(states.groupBy("block").applyInPandas(elite, _PLACED))
    delete(dealt.sparkSession, states.stored_at)
    return out


def packed(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and one END. A document of more than ``capacity`` ids is cut into pieces of that size, the first
    of which may be shorter; others stay whole. Sequences hold ``capacity`` ids at most, their pieces lie
    without gaps from offset 0. ``ids_crc32`` is that of the ids as little-endian 32-bit numbers. The string of a special token
    in a text counts as that token, as tokenizers has it.

    A null or empty text is one END. Ids are carried along, null and repeated ones too, as each row is a document of its
    own; texts of any length are read whole; other columns are ignored; an empty table gives an empty result. The same
    table files give the same packing, as all draws are seeded by block, island and epoch.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, path or default_tokenizer(), id_col, text_col, capacity))
    placed = rows.where(F.col("length") == capacity).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = rows.where(F.col("length") < capacity).select("row", "length", F.lit(None).cast("long").alias("bin"))
    done = [rows]
    for turn in range(ROUNDS):
        blocks = max(1, math.ceil(left.count() / PIECES))
        whole = F.coalesce("bin", "row")  # pieces of a sequence are dealt together
        out = packed_blocks(left.withColumn("block", F.pmod(F.xxhash64(whole, F.lit(turn)), F.lit(blocks))), capacity, turn)
        done.append(out)
        final = blocks == 1 or turn == ROUNDS - 1
        settled = F.lit(True) if final else F.col("fill") == capacity
        placed = placed.union(out.where(settled).select("row", "sequence_id", "offset"))
        if final:
            break
        left = out.where(~settled).select("row", "length", F.col("sequence_id").alias("bin"))
    found = rows.join(placed, "row").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    found = stored(found)
    for x in done:
        delete(spark, x.stored_at)
    return found


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
