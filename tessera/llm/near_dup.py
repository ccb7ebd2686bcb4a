"""Operator 5: near-duplicate detection with HyperMinHash sketches.

Every document gets one sketch of its word shingles: ``REGISTERS`` buckets by the top hash bits, each
holding the leading-zero count and ``MANTISSA`` further bits of the smallest hash in it. Documents with
the same shingle set collapse into one class before anything else, so groups of exact copies cost one
row. Bands of registers propose candidates; the collision-corrected register agreement estimates the
similarity; what the estimate can't rule out is confirmed on the full shingle sets.

No bucket is expanded into all its pairs. In each round, a bucket has one leader, drawn anew, and the members
of other components than the leader's are held against it. Confirmed links form components, and a bucket whose
members are in one component is done. Rounds go on while they close a good part of what is open: many members
that are alike are soon in one component. In the buckets that then stay open, unlike members share a band by
chance; their sketches are compared in blocks inside the tasks, and only pairs of different components that
the estimate can't rule out leave them, each in the first band it shares.

Sets are told by a 128-bit sum of their shingles' 64-bit hashes, and links are confirmed on the full sets of
these hashes: two of the (say) 10^4 shingles of a compared pair are confused with a chance of 3e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import checkpointed, maybe_among, mix, shingle_set, word_hashes
from tessera.session import delete, stored, table

BITS = 9
REGISTERS = 1 << BITS
MANTISSA = 10
#: Two sets of similarity 0.75 share no band with probability (1 - 0.75 ** ROWS) ** BANDS, about 2.5e-7.
BANDS, ROWS = 40, 4
#: Standard deviations of the estimate that a pair may fall short of the threshold before it is ruled out.
DEVIATIONS = 4.5
#: Sketches compared with one another in one group; a larger bucket is dealt out in pairs of blocks.
BLOCK = 2048
#: Rounds of leaders go on while what is open shrinks at least to this share.
SHRINKS = 0.8

_rng = np.random.Generator(np.random.PCG64(5))
#: Where an empty register takes its value from: the first filled one in its own random sequence.
_DONORS = np.stack([_rng.permutation(REGISTERS) for _ in range(REGISTERS)])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of 64-bit hashes; 0 is an empty register."""
    buckets = np.arange(REGISTERS, dtype=np.uint64)
    at = np.searchsorted(shingles, buckets << np.uint64(64 - BITS))
    value = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & (value >> np.uint64(64 - BITS) == buckets)
    rest = value << np.uint64(BITS)
    zeros = np.full(REGISTERS, 64 - BITS, np.uint64)
    some = rest > 0
    exponent = np.frexp(rest[some].astype(np.float64))[1]  # rounding up to a power of two only nears the edge
    zeros[some] = np.minimum(64 - exponent, 64 - BITS).astype(np.uint64)
    mantissa = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    return np.where(filled, (zeros << np.uint64(MANTISSA) | mantissa) + np.uint64(1), np.uint64(0)).astype(np.uint16)


def dense(registers: np.ndarray) -> np.ndarray:
    """The banded registers (rows x BANDS * ROWS) with the empty ones filled from others of the row, so that
    each agrees with a chance of about J."""
    out = registers[:, : BANDS * ROWS].copy()
    for row in range(len(out)):
        empty = np.flatnonzero(out[row] == 0)
        for tries in (32, REGISTERS):
            if len(empty):
                donors = registers[row][_DONORS[empty, :tries]]
                out[row, empty] = donors[np.arange(len(empty)), (donors > 0).argmax(1)]
                empty = empty[out[row, empty] == 0]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """BANDS keys of each row of dense registers."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def estimate(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of one sketch against rows of others, and the registers that each rests on.

    Registers that agree by chance are taken off: two unlike minima of a filled bucket agree with
    probability about 2 ** -MANTISSA / 3 (same octave, 1/3, and same mantissa).
    """
    chance = 2.0**-MANTISSA / 3
    used = np.count_nonzero((one > 0) | (others > 0), axis=1)
    same = np.count_nonzero((one == others) & (one > 0), axis=1)
    return np.clip((same / np.maximum(used, 1) - chance) / (1 - chance), 0, 1), used


def plausible(one: np.ndarray, n_one: int, others: np.ndarray, n_others: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the others may reach the threshold with one.

    The minima of the used registers are a sample without replacement of the union, so at the threshold the
    estimate's variance is hypergeometric: nothing is left to chance once each element has its own bucket.
    """
    guess, used = estimate(one, others)
    union = np.maximum((n_one + n_others) / (1 + threshold), used + 1)
    deviation = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1) * (union - used) / (union - 1).clip(1))
    return guess >= threshold - DEVIATIONS * deviation - 2 / np.maximum(used, 1)


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``_id``, ``n`` (set size), ``k1``, ``k2`` (128 bits that name the set) and ``sig`` of each row."""
    schema = T.StructType(
        [T.StructField("_id", _kind(docs, id_col)), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("sig", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, hashes in word_hashes(batch.column(1)):
                rows = len(offsets) - 1
                n, k1, k2, sig = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), [b""] * rows
                for i in range(rows):
                    s = shingle_set(hashes[offsets[i] : offsets[i + 1]], words)
                    if len(s):
                        n[i], k1[i], k2[i] = len(s), s.sum(), mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum()
                        sig[i] = sketch(s).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sig, pa.binary())],
                    ["_id", "n", "k1", "k2", "sig"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _registers(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _bands(reps: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("band", T.LongType()), T.StructField("rep", _kind(reps, "rep"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                keys = band_keys(dense(_registers(part.column(1))))
                rep = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), rep], ["band", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, schema)


def _plausible(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that sizes and sketches can't rule out."""
    side = reps.select("rep", "n", "sig")
    wide = (
        pairs.join(side.toDF("a", "n_a", "sig_a"), "a")
        .join(side.toDF("b", "n_b", "sig_b"), "b")
        .where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    )
    schema = T.StructType([T.StructField("a", _kind(pairs, "a")), T.StructField("b", _kind(pairs, "b"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                one, other = _registers(batch.column(2)), _registers(batch.column(3))
                n_one, n_other = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                ok = [plausible(one[k], n_one[k], other[k : k + 1], n_other[k : k + 1], threshold)[0] for k in range(len(batch))]
                yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return wide.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(run, schema)


def _open_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Plausible pairs of different components within open buckets.

    ``members``: band, rep, comp, n, sig, size (of the bucket). Groups hold two blocks at most.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    kind = _kind(members, "rep")
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(group: pa.Table) -> pa.Table:
        a, b = [], []
        rep, comp, n, own, band = (group.column(c).to_numpy() for c in ("rep", "comp", "n", "own", "band"))
        order = np.argsort(rep, kind="stable")
        rep, comp, n, own = rep[order], comp[order], n[order], own[order]
        registers = _registers(group.column("sig"))[order]
        keys = band_keys(dense(registers))
        across = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        for i in range(len(rep) - 1):
            rest = np.arange(i + 1, len(rep))
            ok = (comp[rest] != comp[i]) & (np.minimum(n[rest], n[i]) >= threshold * np.maximum(n[rest], n[i]))
            if across:
                ok &= own[rest] != own[i]
            rest = rest[ok]
            rest = rest[plausible(registers[i], n[i], registers[rest], n[rest], threshold)]
            if len(rest):
                first = keys[i][(keys[rest] == keys[i]).argmax(1)]
                rest = rest[first == band[0]]
                a += [rep[i]] * len(rest)
                b += rep[rest].tolist()
        return pa.table({"a": pa.array(a, group.schema.field("rep").type), "b": pa.array(b, group.schema.field("rep").type)})

    return dealt.select("band", "lo", "hi", "own", "rep", "comp", "n", "sig").groupBy("band", "lo", "hi").applyInArrow(run, schema)


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``rep`` and its whole sorted ``shingles`` for the wanted documents."""
    rows = maybe_among(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("_t")), "rep", wanted).join(wanted, "rep", "left_semi")
    schema = T.StructType([T.StructField("rep", _kind(rows, "rep")), T.StructField("shingles", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, hashes in word_hashes(batch.column(1)):
                sets = [shingle_set(hashes[offsets[i] : offsets[i + 1]], words) for i in range(len(offsets) - 1)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), lists], ["rep", "shingles"])

    return rows.select("rep", "_t").mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    both = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("s_a", "s_b")))
    return both.where(F.col("shared") * 100 >= percent * (F.size("s_a") + F.size("s_b") - F.col("shared"))).select("a", "b")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of the edges (a, b).

    Labels spread to neighbours as minima, then jump to the label's own label, so the number of rounds
    grows with the logarithm of a component's diameter. Each round is a written table.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    last = None
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        spread = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("far"))
        spread = stored(spread.join(jump, "now").select("node", "was", F.least("now", "far").alias("component")), replaces=last)
        labels, last = spread.select("node", "component"), spread
        if spread.where("was <> component").isEmpty():
            labels.stored_at = spread.stored_at
            return labels


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members (band, rep, size) with their component; one without links is its own."""
    return members.select("band", "rep", "size").join(components, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    A document's set: the distinct shingles of ``words`` words, lower-cased A-Z; with fewer words the whole
    sequence is one shingle; without words or text (null) the set is empty and the document is linked with
    nothing. Documents with 100 * intersection >= percent * union are linked; ``component_id`` is the
    smallest id that links reach, and the document with that id is ``kept``. Ids are taken as unique
    integers; rows that repeat an id and text share one component. A row without an id is linked with
    nothing: its component is null and it is kept. Texts of any length are read whole, other columns are
    ignored, an empty table gives an empty result. A link of similarity 0.75 is overlooked with a
    probability of about 3e-7 (no shared band) plus 3e-6 (estimate off by DEVIATIONS), less above it.
    """
    threshold = percent / 100
    drawn = checkpointed(sketches(docs, id_col, text_col, words))
    reps = checkpointed(
        drawn.where("n > 0 AND _id IS NOT NULL").groupBy("n", "k1", "k2").agg(F.min("_id").alias("rep"), F.min_by("sig", "_id").alias("sig"))
    )
    bands = _bands(reps)
    buckets = checkpointed(bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
    placed = checkpointed(bands.join(buckets, "band").withColumn("comp", F.col("rep")))
    sets = checkpointed(_full_sets(docs, checkpointed(placed.select("rep").distinct()), id_col, text_col, words))
    links = reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    components = links.toDF("rep", "comp")
    last, done = None, []  # done: tables of the rounds
    while True:
        leader = F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(last or 0))).alias("leader")
        still = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), leader).where("lo <> hi")
        opened = stored(placed.join(still.select("band", "leader"), "band"))
        done.append(opened.stored_at)
        size = opened.count()
        if size == 0 or last is not None and size >= SHRINKS * last:
            break
        last = size
        star = opened.where("comp <> leader.comp").select(F.col("leader.rep").alias("a"), F.col("rep").alias("b")).distinct()
        links = stored(links.union(_confirmed(checkpointed(_plausible(star, reps, threshold)), sets, percent)))
        labels = connected_components(links)
        done += [links.stored_at, labels.stored_at]
        components = labels.toDF("rep", "comp")
        placed = _labelled(opened, components)
    if size:
        candidates = opened.select("band", "rep", "comp", "size").join(reps.select("rep", "n", "sig"), "rep")
        found = checkpointed(_confirmed(checkpointed(_open_pairs(candidates, threshold).distinct()), sets, percent))
        if not found.isEmpty():
            labels = connected_components(links.union(found))
            done.append(labels.stored_at)
            components = labels.toDF("rep", "comp")
    named = reps.join(components, "rep", "left").select("n", "k1", "k2", F.coalesce("comp", "rep").alias("component_id"))
    named = checkpointed(named)
    for path in done:
        delete(docs.sparkSession, path)
    found = drawn.select("_id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    component = F.when(F.col("_id").isNotNull(), component)
    return found.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
