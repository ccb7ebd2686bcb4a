"""Operator 11: whitening of embeddings by hierarchical merging of singular value decompositions.

Each task keeps of the vectors it reads only their number, exact sums, all singular values and right singular
vectors of the centred block. Two such summaries merge without loss: the scaled singular vectors of both and one
row more, the difference of the means weighted by sqrt(n m / (n + m)), are decomposed again. Summaries are merged
in groups of FAN_IN, level by level, so that no task holds more than that many of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import checkpointed
from tessera.session import delete, stored, table

#: Summaries that one task merges.
FAN_IN = 16
#: Bytes of vectors that are decomposed at once.
BLOCK_BYTES = 4 << 20
#: Components with less than this share of the largest one's variance have none but rounding.
LEAST_SHARE = 1e-13
_LONG = 1 << 63
_SUMMARY = "node long, n long, sums array<string>, values array<double>, vectors binary"


@dataclass
class Summary:
    """Number of vectors, their exact sums, and the singular values and right singular vectors (rows) about their mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of the rows of a block of whole numbers."""
        wide = len(x) * int(max(-int(x.min()), int(x.max()), 1)) >= _LONG
        sums = [int(s) for s in (x.astype(object) if wide else x).sum(0)]
        mean = np.array([s / len(x) for s in sums])
        return cls(len(x), sums, *_decomposed(x - mean))

    def merged(self, other: Summary) -> Summary:
        n, m = self.n, other.n
        apart = np.array([(a * m - b * n) / (n * m) for a, b in zip(self.sums, other.sums, strict=True)])
        rows = [self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, math.sqrt(n * m / (n + m)) * apart[None, :]]
        return Summary(n + m, [a + b for a, b in zip(self.sums, other.sums, strict=True)], *_decomposed(np.concatenate(rows)))

    def row(self, node: int) -> dict:
        return {"node": node, "n": self.n, "sums": [str(s) for s in self.sums], "values": self.values.tolist(), "vectors": self.vectors.tobytes()}

    @classmethod
    def read(cls, row) -> Summary:
        sums = [int(s) for s in row["sums"]]
        return cls(int(row["n"]), sums, np.array(row["values"], np.float64), np.frombuffer(row["vectors"]).reshape(-1, len(sums)))


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right singular vectors; tall blocks are first brought to a triangle."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def summarised(vectors: DataFrame, size: int, fan_in: int = FAN_IN) -> Summary | None:
    """The merged summary of all rows of ``x`` (array<long> of this size); None without rows."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        step = max(size, BLOCK_BYTES // (8 * size))
        for batch in batches:
            x = _vectors(batch.column(0), size)
            for at in range(0, len(x), step):
                own = Summary.of(x[at : at + step])
                held = own if held is None else held.merged(own)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.row(TaskContext.get().partitionId())], _arrow())

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        rows = [Summary.read(r) for _, r in group.sort_values("at").iterrows()]
        held = rows[0]
        for own in rows[1:]:
            held = held.merged(own)
        return pd.DataFrame([held.row(int(group["node"].iloc[0]))])

    level = checkpointed(vectors.mapInArrow(blocks, _SUMMARY))
    while True:
        last = level.agg(F.max("node")).first()[0]
        if last is None:
            return None
        if last == 0:
            return Summary.read(level.first())
        dealt = level.withColumn("at", F.col("node")).withColumn("node", F.floor(F.col("node") / fan_in))
        level = checkpointed(dealt.groupBy("node").applyInPandas(merge, _SUMMARY))


def _arrow() -> pa.Schema:
    return pa.schema(
        [("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("values", pa.list_(pa.float64())), ("vectors", pa.binary())]
    )


@dataclass
class Whitening:
    """Mean and exact sums of the fit list, and its components by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray  # unit rows

    @property
    def trace(self) -> float:
        return float(self.eigenvalues.sum())

    @classmethod
    def fit(cls, summary: Summary) -> Whitening:
        size = len(summary.sums)
        values = np.zeros(size)
        values[: len(summary.values)] = summary.values**2 / summary.n
        vectors = summary.vectors
        if len(vectors) < size:  # fewer vectors than dimensions: any rows that complete the basis have no variance
            full = np.linalg.svd(vectors)[2]
            vectors = np.concatenate([vectors, full[len(vectors) :]])
        return cls(summary.n, summary.sums, values, vectors)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, exact, and x - S / n."""
        wide = self.n * int(max(-int(x.min()), int(x.max()), 1)) + max(map(abs, self.sums)) >= _LONG if len(x) else False
        exact = (x.astype(object) if wide else x) * self.n - np.array(self.sums, object if wide else np.int64)
        return exact, (exact / self.n).astype(np.float64)

    def whitened(self, centred: np.ndarray, components: int) -> np.ndarray:
        """Coordinates of unit variance; NaN for components that have none."""
        e = self.eigenvalues[:components]
        scale = np.where(e > LEAST_SHARE * self.eigenvalues[0], e, np.nan) if len(e) and self.eigenvalues[0] > 0 else np.full(len(e), np.nan)
        return centred @ self.components[:components].T / np.sqrt(scale)


def _squares(exact: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exact; None where 64 bits don't hold them."""
    if exact.dtype != object and exact.size:
        most = int(max(-int(exact.min()), int(exact.max())))
        if most * most * exact.shape[1] < _LONG:
            return (exact * exact).sum(1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in exact]
    return [s if s < _LONG else None for s in sums]


def identity_error(vectors: DataFrame, model: Whitening, size: int, components: int) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, over components with variance."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            w = model.whitened(model.centred(_vectors(batch.column(0), size))[1], components)
            sums, squares = sums + w.sum(0), squares + w.T @ w
        flat = np.concatenate([sums, squares.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])

    found = vectors.mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(components + components**2)
    for r in found:
        flat[r["k"]] = r["v"]
    mean, squares = flat[:components] / model.n, flat[components:].reshape(components, components) / model.n
    apart = np.abs(squares - np.outer(mean, mean) - np.eye(components))
    return float(np.nanmax(apart, initial=0.0))


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Entries become whole numbers, floor(scale * entry). Rows whose vector is null or holds null, NaN or infinite
    entries are left out, and so are vectors of another length than most of the rest have (of equally frequent lengths the smaller one
    counts). The model is fitted to each distinct vector once and keeps all dimensions: n vectors with sums S,
    covariance with divisor n. ``deviation`` is the exact sum over dimensions of (n x - S)^2, null where 64 bits don't
    hold it; ``whitened`` is the projection of x - S / n over the root of the component's variance; ``explained`` is
    the component's share of all variance. Components without variance (fewer distinct vectors than components,
    constant vectors) have a null ``whitened`` and share 0, and don't count in ``identity_error``. Ids are carried
    along, null and repeated ones too; other columns are ignored; without vectors the result is empty. Entries
    beyond 2^63 / scale are taken as that bound.
    """
    entry = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rows = df.where(F.col(vector_col).isNotNull() & F.forall(vector_col, good))
    lengths = rows.groupBy(F.size(vector_col).alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    components = min(components, size)
    rows = rows.where(F.size(vector_col) == size).select(F.col(id_col).alias("id"), F.transform(vector_col, entry).alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if components == 0:
        return df.sparkSession.createDataFrame([], schema)
    fit = stored(rows.select("x").distinct())
    summary = summarised(fit, size)
    model = Whitening.fit(summary)
    error = identity_error(fit, model, size, components)
    delete(df.sparkSession, fit.stored_at)
    share = model.eigenvalues[:components] / model.trace if model.trace > 0 else np.zeros(components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            exact, centred = model.centred(_vectors(batch.column(1), size))
            w = model.whitened(centred, components).ravel()
            again = np.repeat(np.arange(m), components)
            columns = [
                batch.column(0).take(pa.array(again)),
                pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), m)),
                pa.array(np.full(len(again), model.n)),
                pa.array(_squares(exact), pa.int64()).take(pa.array(again)),
                pa.array(w, mask=np.isnan(w)),
                pa.array(np.tile(share, m)),
                pa.array(np.full(len(again), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
