"""Operator 9: quality by importance resampling over hashed n-grams.

Two generative models count hashed words and word pairs: one over texts labelled good, one over all raw
texts. A text's importance weight is the log ratio of its likelihoods under the two. Gumbel noise from a
hash of its id is added, and the ``k`` largest sums are kept, which samples without replacement in proportion
to the weights.

Counts are summed within each task before they move; the driver sees one row for each hash bucket. The
cut between kept and other rows is found by counting rows in ranges of keys and narrowing the range that
holds it, so no task sorts the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import checkpointed, grams, word_hashes
from tessera.session import table

#: Hash buckets of the n-gram models, and the n-gram lengths.
BUCKETS, ORDERS = 10_000, (1, 2)
#: Added to every bucket's count before it is turned into a probability.
SMOOTHING = 1.0
#: Labelled target rows that the target model learns from, at most; those of the smallest id hashes.
TARGET_ROWS = 200_000
SEED = 7
#: Ranges of one narrowing step; the driver sees one row for each.
RANGES = 4096


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _features(hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram, by order."""
    for n in ORDERS:
        found = grams(hashes, n)
        at = np.arange(len(found))
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + n <= offsets[row + 1] if len(at) else np.zeros(0, bool)
        yield row[inside], (found[inside] % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all rows, and of those marked as target. ``rows``: any column, text, ``target``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            marked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, offsets, hashes in word_hashes(batch.column(0)):
                for row, bucket in _features(hashes, offsets):
                    every += np.bincount(bucket, minlength=BUCKETS)
                    target += np.bincount(bucket[marked[row + first]], minlength=BUCKETS)
        used = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(every[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    counted = rows.mapInArrow(run, "bucket long, raw long, target long")
    summed = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[summed["bucket"]], target[summed["bucket"]] = summed["raw"], summed["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: log of its target probability over its raw probability; 0 without any target row."""
    if not target.sum():
        return np.zeros(len(raw))
    p, q = (np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c))) for c in (target, raw))
    return p - q


def log_weights(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """The id, ``n_features`` and ``log_weight`` (sum over the whole text) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([docs.schema[id_col], T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, hashes in word_hashes(batch.column(1)):
                size = len(offsets) - 1
                n, total = np.zeros(size, np.int64), np.zeros(size)
                for row, bucket in _features(hashes, offsets):
                    n += np.bincount(row, minlength=size)
                    total += np.bincount(row, sent.value[bucket], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, size), pa.array(n), pa.array(total)], schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of the id: the same for the same id in every run."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def _cut(rows: DataFrame, column: str, need: int, integral: bool) -> tuple[float | int | None, int]:
    """(least of the largest ``need`` values, how many of its equals are needed), found by narrowing ranges."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        inside = rows.where(F.col(column).between(F.lit(low), F.lit(high)))
        if integral:
            step = (high - low) // RANGES + 1
            number = F.floor((F.col(column) - F.lit(low)) / F.lit(step)) if step < 1 << 40 else F.expr(f"({column} - {low}L) div {step}L")
        else:
            number = F.least(F.floor((F.col(column) - low) * (RANGES / (high - low))), F.lit(RANGES - 1))
        ranges = inside.groupBy(number.alias("range")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(ranges.collect(), key=lambda r: -r["range"]):
            if r["n"] >= need:
                low, high = r["low"], r["high"]
                break
            need -= r["n"]
    return low, need


def gumbel_top_k(rows: DataFrame, id_col: str, key: str, k: int) -> Column:
    """Whether a row is among the ``k`` largest keys; of equal keys the largest ids come first.

    Rows that repeat key and id at the cut are all in, so that copies of a row have one fate.
    """
    if k <= 0:
        return F.lit(False)
    least, need = _cut(rows, key, k, False)
    ties = rows.where(F.col(key) == F.lit(least)).select(F.xxhash64(id_col).alias("_order")) if least is not None else None
    if ties is None:
        return F.lit(False)
    if ties.count() <= need:
        return F.coalesce(F.col(key) >= F.lit(least), F.lit(False))
    order, _ = _cut(ties.select(F.shiftrightunsigned("_order", 1).alias("_order")), "_order", need, True)
    tied = (F.col(key) == F.lit(least)) & (F.shiftrightunsigned(F.xxhash64(id_col), 1) >= F.lit(order))
    return F.coalesce((F.col(key) > F.lit(least)) | tied, F.lit(False))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fraction: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_features``, ``log_weight``, ``gumbel_key``, ``kept``.

    The target model learns from rows labelled 1 that are not held out (``TARGET_ROWS`` at most), the raw model
    from all rows. ``ceil(fraction * rows)`` rows are kept; without a ``fraction`` it is the share of label 1
    among the training labels (1 without labels). Null and empty texts have no features and weight 0. Null
    labels are left out; repeated labels of a document count once. Rows that repeat an id get the same noise.
    Without any target row all weights are 0 and the sample is uniform. Only the named columns are read. An empty
    table gives an empty result.
    """
    known = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where(F.col("_y").isNotNull() & F.col("_label_id").isNotNull() & ~held_out("_label_id"))
    if fraction is None:
        share = known.agg(F.avg((F.col("_y") > 0).cast("int"))).first()[0]
        fraction = 1.0 if share is None else share
    target = known.where("_y > 0").select("_label_id").distinct().orderBy(F.xxhash64("_label_id"), "_label_id").limit(TARGET_ROWS)
    target = F.broadcast(checkpointed(target.withColumn("target", F.lit(True))))
    rows = docs.select(id_col, text_col).join(target, F.col(id_col) == F.col("_label_id"), "left")
    ratios = log_ratios(*bucket_counts(rows.select(text_col, F.coalesce("target", F.lit(False)).alias("target"))))
    scored = log_weights(docs, ratios, id_col, text_col)
    scored = checkpointed(scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(id_col, seed)))
    kept = gumbel_top_k(scored, id_col, "gumbel_key", math.ceil(fraction * scored.count()))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "n_features", "log_weight", "gumbel_key", kept.alias("kept"))


def op9_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
