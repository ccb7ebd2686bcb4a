"""Sources and sinks: tables with a fixed schema, file listings, documents of JSON, keyed snapshots."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import tables


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """A CSV with header and declared types; of ``columns`` those that exist are kept, and only they are parsed. With ``strict``
    one that doesn't exist is an error."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    if strict and (unknown := [c for c in columns or () if c not in df.columns]):
        raise ValueError(f"no columns {unknown}")
    return df if columns is None else df.select(*(c for c in columns if c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself, if its columns are exactly these."""
    if df.columns != list(columns):
        raise ValueError(f"columns {df.columns}, expected {list(columns)}")
    return df


def listed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path``, ``label`` (parent folder), ``name``, ``length`` of all files below a folder; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    parts = F.split("path", "/")
    return files.select("path", F.try_element_at(parts, F.lit(-2)).alias("label"), F.element_at(parts, -1).alias("name"), "length")


def first_fraction(df: DataFrame, order: str, fraction: float) -> DataFrame:
    """The first ``floor(rows * fraction)`` rows by a column of distinct values."""
    return tables.first_rows(df, [order], int(df.count() * fraction))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first of a few candidate paths that exists in its file system, None if none does."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return next((p for p in paths if fs(p).getFileSystem(conf).exists(fs(p))), None)


def numbered_folders(spark: SparkSession, path: str, glob: str = "*", most: int | None = None) -> DataFrame:
    """(``id``, ``files``) of the sub-folders named by digits, in numeric order, the first ``most`` of them."""
    files = listed_files(spark, path, glob).where(F.col("label").rlike("^[0-9]+$"))
    found = files.groupBy(F.col("label").alias("id")).agg(F.count("*").alias("files")).orderBy(F.length(F.ltrim("id", F.lit("0"))), F.ltrim("id", F.lit("0")), "id")
    return found if most is None else found.limit(most)


def read_json_config(spark: SparkSession, path: str) -> dict:
    """One JSON document as a dict; {} where there is no file. For configurations, which are small."""
    if first_existing(spark, [path]) is None:
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_json_config(spark: SparkSession, path: str, config: dict) -> None:
    """Writes one small JSON document as the one part of a folder of text."""
    text = json.dumps(config, indent=2, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def artifacts(spark: SparkSession, path: str, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """(``artifact``, ``path``): of each wanted artifact the first of its candidate relative paths below ``path`` that exists."""
    rows = [(name, k, rel) for name, rels in wanted.items() for k, rel in enumerate(rels)]
    candidates = spark.createDataFrame(rows, "artifact string, place int, rel string")
    files = listed_files(spark, path).select("path")
    found = files.join(F.broadcast(candidates), F.endswith(F.col("path"), F.concat(F.lit(path.rstrip("/").removeprefix("file:") + "/"), F.col("rel"))))
    return found.groupBy("artifact").agg(F.min_by("path", "place").alias("path"))


def refuse_existing(spark: SparkSession, path: str) -> str:
    """The path itself if nothing is there; an error if something is."""
    if first_existing(spark, [path]) is not None:
        raise FileExistsError(path)
    return path


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row for each file of one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_snapshot(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replaces the partitions of the keys that ``df`` has and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def resume_point(spark: SparkSession, path: str, step: int | None = None, prefix: str = "checkpoint-") -> tuple[str, int] | None:
    """(path, step) of the checkpoint folder below ``path`` to go on from: that of the named step, which must be there, or else the
    latest one; None where there is none yet."""
    from tessera.sources.containers import latest_numbered  # which builds on this module

    if step is not None:
        named = f"{path.rstrip('/')}/{prefix}{step}"
        if first_existing(spark, [named]) is None:
            raise FileNotFoundError(named)
        return named, step
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [(str(f.getPath()),) for f in files.listStatus(place) if f.isDirectory()] if files.exists(place) else []  # a folder a checkpoint
    found = latest_numbered(spark.createDataFrame(folders, "path string"), prefix).first()
    return (found["path"], found["number"]) if found else None


def delete_broken(spark: SparkSession, broken: DataFrame) -> int:
    """Deletes the files named in the column ``path`` one by one, and tells how many were there.

    What has to be made again is then ``tables.renewed`` of the expected and the remaining keys. Paths are those of one store that every
    executor reaches; a path that is gone already, or comes twice, counts once or not at all.
    """
    from tessera.session import delete

    gone = 0
    for r in broken.select("path").where("path IS NOT NULL").distinct().toLocalIterator():  # broken ones are few; names alone are held, a partition at a time
        if first_existing(spark, [r["path"]]) is not None:
            delete(spark, r["path"])
            gone += 1
    return gone
