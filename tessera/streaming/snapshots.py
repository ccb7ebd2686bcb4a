"""Structured Streaming: windowed counts with a watermark, and idempotent snapshots by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.files import write_snapshot


def read_events(spark: SparkSession, path: str, glob: str = "events.parquet") -> DataFrame:
    """Parquet files of events as a stream, with the schema of those that are there."""
    schema = spark.read.parquet(f"{path}/{glob}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob if glob.endswith("parquet") else "*").parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their sum by window and type, rows later than ``late`` left out."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def snapshot_sink(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Writes each batch over the partitions of its keys, so that a batch run twice leaves one result."""
    if not isinstance(checkpoint, str) or isinstance(keys, str):
        raise TypeError("checkpoint is a path, keys are a list of columns")
    return (
        stream.writeStream.foreachBatch(lambda df, _: write_snapshot(df, path, keys))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends rows to CSV files as they come, each file with its header; nothing is held back. Spark's own file sink, so
    that a batch run twice is written once."""
    return (
        stream.writeStream.format("csv")
        .option("header", True)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
