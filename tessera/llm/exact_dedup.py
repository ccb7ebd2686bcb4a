"""Operator 6: exact deduplication by 128-bit content hash with a byte comparison inside groups.

Built from DataFrame functions only. Texts are read twice: once to hash them, once to compare the
bytes of those whose hash occurs more than once, found by a bitmap of fixed size (few others pass it and
only add groups of one). The comparison is an aggregation whose key is the text itself, so copies collapse before
the shuffle and a group of any size meets as one row per map task. The last join is a plain equi-join of two shuffled inputs, so adaptive
execution can split a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import checkpointed, lower_az, maybe_among
from tessera.session import table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty
    texts form one group. ``keep`` names the id that stays: ``min`` (smallest) or ``max``. Ids are
    taken as unique; rows that repeat id and text are one document and all say ``kept``. A null id
    never stays unless its whole group has none. Other columns, whatever their names, are ignored.
    An empty table gives an empty result. Two texts that share the 128-bit hash but differ in bytes
    fall into different groups.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select("_id", lower_az(F.col("_t")).alias("_t")).withColumn("_h", F.unhex(F.md5("_t")))
    hashed = checkpointed(rows.select("_id", "_h", F.sha2("_t", 256).alias("_sha")))
    repeated = checkpointed(hashed.groupBy("_h").count().where("count > 1").select("_h"))
    compared = maybe_among(rows, "_h", repeated).groupBy("_h", "_t").agg(pick("_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = checkpointed(compared.select("_h", F.sha2("_t", 256).alias("_sha"), "keep_id", "group_size"))
    doubly = groups.groupBy("_h", "_sha").count().where("count > 1")
    if not doubly.isEmpty():
        raise ValueError("different texts share both their MD5 and their SHA-256")
    keep_id = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return (
        hashed.join(groups, ["_h", "_sha"], "left")
        .withColumn("keep_id", keep_id)
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP6_SQL = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""
