"""Files that hold other files or arrays: zip members, array archives, sound. One task reads one file at a time.

Spark's readers list no empty files; ``runs.missing_names`` against the expected names finds those.
"""

from __future__ import annotations

import io
import wave
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import tables


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")


def zip_members(spark: SparkSession, path: str, glob: str = "*.zip", contents: bool = False) -> DataFrame:
    """(archive, member, size, content, error): a row a member; an archive that can't be read is one row with its error.
    Contents are read on demand only."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, data in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                yield pd.DataFrame({"archive": [at], "member": [m.filename], "size": [m.file_size], "content": [z.read(m) if contents else None], "error": [None]})
                except (zipfile.BadZipFile, OSError, RuntimeError) as e:
                    yield pd.DataFrame({"archive": [at], "member": [None], "size": [None], "content": [None], "error": [str(e)]})

    return _files(spark, path, glob).mapInPandas(members, "archive string, member string, size long, content binary, error string")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def picked_member(members: DataFrame, name: str) -> DataFrame:
    """By archive the member of this base name; of several the shortest path, then the first by name."""
    return tables.keep_first(members.where(base_name(F.col("member")) == name), ["archive"], [F.length("member"), F.col("member")])


def array_archives(spark: SparkSession, path: str, required: Sequence[str], glob: str = "*.npz") -> DataFrame:
    """(path, ok, error, shapes): whether every array of an archive can be read and the required ones are there."""

    def probed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, data in zip(frame["path"], frame["content"]):
                shapes, error = {}, None
                try:
                    with np.load(io.BytesIO(data), allow_pickle=False) as z:
                        shapes = {k: "x".join(map(str, z[k].shape)) for k in z.files}
                    absent = [k for k in required if k not in shapes]
                    error = f"without {', '.join(absent)}" if absent else None
                except (zipfile.BadZipFile, OSError, ValueError, EOFError) as e:
                    error = str(e) or type(e).__name__
                yield pd.DataFrame({"path": [at], "ok": [error is None], "error": [error], "shapes": [shapes]})

    return _files(spark, path, glob).mapInPandas(probed, "path string, ok boolean, error string, shapes map<string,string>")


def sounds(spark: SparkSession, path: str, size: int, glob: str = "*.wav") -> DataFrame:
    """(path, rate, samples, error): the first channel of 16-bit sound in -1 to 1, cut or padded with 0 to ``size``."""

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, data in zip(frame["path"], frame["content"]):
                rate, samples, error = None, None, None
                try:
                    with wave.open(io.BytesIO(data)) as w:
                        if w.getsampwidth() != 2:
                            raise wave.Error(f"{8 * w.getsampwidth()} bits a sample")
                        rate, one = w.getframerate(), np.frombuffer(w.readframes(size), "<i2")[:: w.getnchannels()] / 32768.0
                    samples = np.pad(one, (0, size - len(one))).tolist()
                except (wave.Error, EOFError) as e:
                    error = str(e) or type(e).__name__
                yield pd.DataFrame({"path": [at], "rate": [rate], "samples": [samples], "error": [error]})

    return _files(spark, path, glob).mapInPandas(decoded, "path string, rate int, samples array<double>, error string")


def scan_pairs(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(path, id, kind) of files ``<id>/<id>-<kind>.<suffix>`` whose folder is a number and whose name begins with it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")
    folder, kind = F.regexp_extract("path", r"/([0-9]+)/([0-9]+)-([^/.]+)\.[^/]*$", 1), F.regexp_extract("path", r"/([0-9]+)/\1-([^/.]+)\.[^/]*$", 2)
    return files.select("path", folder.alias("id"), kind.alias("kind")).where("id <> '' AND kind <> ''")


def latest_numbered(paths: DataFrame, prefix: str) -> DataFrame:
    """The path whose name is ``prefix`` and the greatest whole number; none where no name is."""
    number = F.regexp_extract(base_name(F.rtrim("path", F.lit("/"))), f"^{prefix}([0-9]+)$", 1).try_cast("long")
    return paths.agg(F.max_by("path", number).alias("path"), F.max(number).alias("number")).where("number IS NOT NULL")
