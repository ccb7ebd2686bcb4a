"""The corpus pipeline: toxic documents, copies, near copies and leaked benchmark items go; the rest is encoded.

Each stage is a function of (spark, docs, sf_dir). ``docs`` is what its predecessor kept, with the columns of
``documents``; all stages but the last return those columns. Rows keep their column values, null and empty
texts are clean documents, and an empty table gives an empty result.

Toxic rows and leaks are told in the tasks that read them, row by row. Copies go by id and text digest, so that a
row without an id goes too if a copy with an id stays, and rows that share an id but not the text are judged apart.
Near copies go by id alone: ids are taken as unique there, a row without an id stays, and rows that repeat id
and text (equal in all the pipeline looks at) share their fate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, exact_dedup, near_dup, pieces, toxicity
from tessera.llm.shared import checkpointed, lower_az, marked
from tessera.session import delete, shared_folder, table


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not among the keys in ``dropped`` (column ``__key``).

    Most rows are told by a bitmap of fixed size in the tasks that read them; those it can't clear are joined
    by a shuffle, few while the bitmap is sparse.
    """
    keys = checkpointed(dropped.where("__key IS NOT NULL").distinct())
    rows = marked(docs.withColumn("__key", key), "__key", keys)
    clear = rows.where("NOT __maybe").select(*docs.columns)
    return clear.union(rows.where("__maybe").join(keys, "__key", "left_anti").select(*docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar of operator 7 scores under its threshold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id."""
    copies = exact_dedup.exact_dedup(docs, keep="max").where("NOT kept")
    own = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(lower_az(F.coalesce("text", F.lit(""))), 256))
    return _without(docs, own, copies.select(F.concat_ws(":", F.col("doc_id").cast("string"), "text_sha256").alias("__key")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked near copies: the smallest id."""
    return _without(docs, F.col("doc_id"), near_dup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__key")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the digests of ids and decoded text."""
    # small caches: executors that ran the stages before have less room than those that only encode
    encoded = pieces.encode_decode(docs, pieces.default_model(), cache_bytes=pieces.CACHE_BYTES // 3)
    return pieces.digests(encoded, also=("ids",))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]
#: Near copies, tiling and encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again. A stage's
    folder is deleted when the next one is written; the last one, which the result reads, is the caller's."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            delete(spark, last)
        last = path
    return docs
