"""Kernel methods on feature arrays (key, features array<double>): principal components and machines with a polynomial kernel."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import learning, ordered, tables
from tessera.session import delete, stored

#: Rows of a block of the kernel; a task holds the product of two blocks.
BLOCK = 1024
#: Rows at most that a kernel machine compares with. They are drawn by a hash of the key; all rows are trained on.
LANDMARKS = 400


#: Monomials at most by whose sums components are found; wider kernels are made block by block.
MONOMIALS = 1 << 16
#: Rows whose monomials a task has at once.
CHUNK = 256
#: Monomials of one row of a task's sums.
PIECE = 2048


@dataclass(frozen=True)
class Polynomial:
    """(gamma * <x, y> + constant) ^ degree; without a gamma one over the number of features."""

    degree: int = 3
    constant: float = 1.0
    gamma: float | None = None

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        gamma = 1.0 / x.shape[1] if self.gamma is None else self.gamma
        return (gamma * (x @ y.T) + self.constant) ** self.degree

    def monomials(self, width: int) -> int:
        """How many monomials of up to this degree there are in so many features."""
        return math.comb(width + self.degree, self.degree)

    def weights(self, width: int) -> np.ndarray:
        """What the product of two rows' monomials (see ``_monomials``) counts in the kernel, for each monomial."""
        gamma = 1.0 / width if self.gamma is None else self.gamma
        found = []
        for at in combinations_with_replacement(range(width + 1), self.degree):
            ways = math.factorial(self.degree)
            for k in set(at):
                ways //= math.factorial(at.count(k))
            ones = at.count(0)
            found.append(ways * self.constant**ones * gamma ** (self.degree - ones))
        return np.array(found)


def _monomials(x: np.ndarray, degree: int) -> np.ndarray:
    """All products of ``degree`` entries of each row and a leading 1, in the order of ``combinations_with_replacement``."""
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    out, first = z, np.arange(z.shape[1] + 1)  # monomials whose least entry is k begin at first[k]
    for _ in range(degree - 1):
        out = np.concatenate([z[:, k : k + 1] * out[:, first[k] :] for k in range(z.shape[1])], 1)
        first = np.concatenate([[0], np.cumsum(first[-1] - first[:-1])])
    return out


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, -1)


def _blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """(b, keys, n, x): the rows in blocks by the order of their distinct key."""
    kind = df.schema[key].dataType.simpleString()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_rank")
        x = np.stack(group["features"].to_numpy()).astype(np.float64)
        return pd.DataFrame([{"b": int(group["b"].iloc[0]), "keys": group["_k"].tolist(), "n": len(x), "x": x.tobytes()}])

    rows = ordered.ranked(df.select(F.col(key).alias("_k"), "features"), [], ["_k"]).withColumn("b", F.floor(F.col("_rank") / size))
    return rows.groupBy("b").applyInPandas(pack, f"b long, keys array<{kind}>, n int, x binary")


def _times(left: DataFrame, right: DataFrame, blocks: int, kernel: Polynomial) -> DataFrame:
    """(b, y): the rows of ``left`` (b, n, x) against all of ``right`` (b, n, x, v), summed over its blocks.

    A pair of blocks is one product in one task; the kernel's blocks are made anew each time and never stored.
    """
    asked = left.select("b", "n", "x").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = asked.join(right.select(F.col("b").alias("j"), F.col("n").alias("m"), F.col("x").alias("z"), "v"), "j")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [kernel(_matrix(r.x, r.n), _matrix(r.z, r.m)) @ _matrix(r.v, r.m) for r in batch.itertuples()]
            yield pd.DataFrame({"b": batch["b"], "y": [y.ravel() for y in out]})

    parts = pairs.mapInPandas(multiply, "b long, y array<double>")

    def total(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"b": int(group["b"].iloc[0]), "y": np.sum(np.stack(group["y"].to_numpy()), 0).tobytes()}])

    return parts.groupBy("b").applyInPandas(total, "b long, y binary")  # as many parts as blocks


@dataclass
class KernelComponents:
    """Blocks (b, keys, n, x, v) of the training rows with their places in the unit eigenvectors, and the eigenvalues."""

    kernel: Polynomial
    blocks: DataFrame
    count: int
    eigenvalues: np.ndarray
    shift: np.ndarray  # the mean row of the kernel's product with the eigenvectors

    def training(self) -> DataFrame:
        """(key, features) of the training rows: the eigenvectors times the roots of their eigenvalues."""
        root = np.sqrt(self.eigenvalues)

        def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    yield pd.DataFrame({"key": list(r.keys), "features": list(_matrix(r.v, r.n) * root)})

        kind = self.blocks.schema["keys"].dataType.elementType.simpleString()
        return self.blocks.select("keys", "n", "v").mapInPandas(scale, f"key {kind}, features array<double>")

    def project(self, df: DataFrame, key: str) -> DataFrame:
        """(key, features) of other rows."""
        own = stored(_blocks(df, key, BLOCK))
        root, shift, width = np.sqrt(self.eigenvalues), self.shift, len(self.eigenvalues)

        def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    y = _matrix(r.y, r.n)[:, :width]
                    yield pd.DataFrame({"key": list(r.keys), "features": list((y - shift) / root)})

        kind = own.schema["keys"].dataType.elementType.simpleString()
        products = _times(own, self.blocks, self.count, self.kernel)
        return own.select("b", "keys", "n").join(products, "b").select("keys", "n", "y").mapInPandas(scale, f"key {kind}, features array<double>")


@dataclass
class MonomialComponents:
    """The training rows, and their components as maps of a row's monomials."""

    kernel: Polynomial
    train: DataFrame
    eigenvalues: np.ndarray
    own: np.ndarray  # of training rows onto their places in the unit eigenvectors
    other: np.ndarray  # of any rows onto the kernel's products with the eigenvectors

    def _mapped(self, df: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
        degree, sent = self.kernel.degree, df.sparkSession.sparkContext.broadcast(turn)

        @F.arrow_udf("array<double>")
        def place(features: pa.Array) -> pa.Array:
            turn = sent.value
            x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1 if len(features) else 1)
            out = [_monomials(x[k : k + CHUNK], degree) @ turn[1:] - turn[0] for k in range(0, len(x), CHUNK)]
            out = np.concatenate([*out, np.zeros((0, turn.shape[1]))])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1]), pa.array(out.ravel()))

        return df.select(F.col(key).alias("key"), place(F.col("features").cast("array<double>")).alias("features"))

    def training(self) -> DataFrame:
        """(key, features) of the training rows: the eigenvectors times the roots of their eigenvalues."""
        return self._mapped(self.train, "key", self.own * np.sqrt(self.eigenvalues))

    def project(self, df: DataFrame, key: str) -> DataFrame:
        """(key, features) of other rows."""
        return self._mapped(df, key, self.other / np.sqrt(self.eigenvalues))


def _monomial_components(own: DataFrame, n: int, features: int, parts: int, kernel: Polynomial, extra: int, tolerance: float, rounds: int, seed: int) -> MonomialComponents:
    """The block iteration over the monomials' sums: a round is one pass over the rows (key, features), whose tasks each hand on a
    matrix of monomials by vectors. The first row of such a matrix belongs to what is taken from all rows."""
    spark = own.sparkSession
    degree, weights = kernel.degree, kernel.weights(features)[:, None]
    size = len(weights)
    width = min(parts + extra, n - 1, size)

    def summed(turn: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Sums over rows of monomials times y, and of y times y, where y is what ``turn`` gives; without it of the monomials, and none."""
        sent = spark.sparkContext.broadcast(turn)
        columns = 1 if turn is None else turn.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn = sent.value
            sums, gram = np.zeros((size, columns)), np.zeros((columns, columns))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), features)
                for k in range(0, len(x), CHUNK):
                    m = _monomials(x[k : k + CHUNK], degree)
                    y = np.ones((len(m), 1)) if turn is None else m @ turn[1:] - turn[0]
                    gram += y.T @ y
                    for at in range(0, size, PIECE):
                        sums[at : at + PIECE] += m[:, at : at + PIECE].T @ y
            for at in range(0, size, PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sums[at : at + PIECE].tobytes()])], ["at", "s"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([gram.tobytes()])], ["at", "s"])

        def total(group: pd.DataFrame) -> pd.DataFrame:
            found = np.sum([np.frombuffer(s) for s in group["s"]], 0)
            return pd.DataFrame([{"at": int(group["at"].iloc[0]), "s": found.tobytes()}])

        found = own.select("features").mapInArrow(run, "at long, s binary").groupBy("at").applyInPandas(total, "at long, s binary").collect()
        sent.destroy()
        by_place = {r["at"]: np.frombuffer(r["s"]).reshape(-1, columns) for r in found}
        return np.concatenate([by_place[k] for k in range(0, size, PIECE)]), by_place[-1]

    mean = summed(None)[0].T / n

    def centred(sums: np.ndarray) -> np.ndarray:
        """The map of monomials onto the centred products of the kernel, from the vectors' sums."""
        turn = weights * sums
        return np.concatenate([mean @ turn, turn])

    turn = centred(np.random.Generator(np.random.PCG64(seed)).normal(size=(size, width)) / np.sqrt(np.maximum(np.abs(weights), 1e-300)))
    before = np.zeros(parts)
    for _ in range(rounds):
        sums, gram = summed(turn)
        length = np.sqrt(np.diag(gram))
        scale = np.where(length > 1e-13 * length.max(), 1 / np.where(length > 0, length, 1), 0)
        values, axes = np.linalg.eigh(scale[:, None] * gram * scale)  # of columns of length 1, so that small components count
        keep = values > 1e-13 * values[-1]
        straight = scale[:, None] * axes * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)
        sums = sums @ straight
        values, axes = np.linalg.eigh(sums.T @ (weights * sums))
        values, axes = values[::-1], axes[:, ::-1]
        sums, kept = sums @ axes, min(parts, width)
        done = np.abs(values[:kept] - before[:kept]).max() <= tolerance * max(values[0], 1e-300)
        before = values[:parts].copy()
        if done:
            return MonomialComponents(kernel, own, np.maximum(values[:kept], 1e-300), turn @ (straight @ axes)[:, :kept], centred(sums[:, :kept]))
        turn = centred(sums)
    raise RuntimeError(f"components not settled after {rounds} rounds")


def kernel_components(
    train: DataFrame, key: str, parts: int, kernel: Polynomial = Polynomial(), extra: int = 16, tolerance: float = 1e-9, rounds: int = 200, block: int = BLOCK, seed: int = 0
) -> MonomialComponents | KernelComponents:
    """The leading principal components of the centred kernel of all rows (keys distinct).

    Block power iteration with ``extra`` vectors more than wanted: a round multiplies the kernel, block by block, with all of them, takes the
    mean out and makes them orthogonal by their small Gram matrix. It ends when the wanted eigenvalues change by less than
    ``tolerance``; with more vectors than the kernel has large eigenvalues that takes few rounds. Without agreement after ``rounds`` it is an error. Fewer rows
    than components give fewer components.

    Where the features have at most MONOMIALS monomials up to the degree, the kernel is never made: it is a scalar product of monomials, and a round
    is one pass over the rows, in as many tasks as Spark has cores, which hand on a matrix of monomials by vectors each. What moves doesn't grow with the
    rows, which are dealt once. With more monomials the work is quadratic in the rows, as the kernel is; no task holds more than two blocks.
    """
    spark = train.sparkSession
    given = train.select(F.col(key).alias("key"), F.col("features").cast("array<double>").alias("features"))
    features = given.select(F.size("features")).first()
    if features is not None and kernel.monomials(features[0]) <= MONOMIALS:
        dealt = stored(given.repartition(spark.sparkContext.defaultParallelism))
        return _monomial_components(dealt, dealt.count(), features[0], parts, kernel, extra, tolerance, rounds, seed)
    own = stored(_blocks(train, key, block))
    sizes = own.select(F.count("*"), F.sum("n")).first()
    count, n = int(sizes[0]), int(sizes[1] or 0)
    width = min(parts + extra, max(n - 1, 0))
    if width == 0:
        raise ValueError("no rows to find components of")

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            draws = [np.random.Generator(np.random.PCG64([seed, r.b])).normal(size=(r.n, width)).tobytes() for r in batch.itertuples()]
            yield pd.DataFrame({"b": batch["b"], "v": draws})

    def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column sums of y, its Gram matrix, and its product with v; from (n, v, y) by blocks."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(width + 2 * width * width)
            for batch in batches:
                for r in batch.itertuples():
                    y, v = _matrix(r.y, r.n), _matrix(r.v, r.n)
                    sums += np.concatenate([y.sum(0), (y.T @ y).ravel(), (v.T @ y).ravel()])
            yield pd.DataFrame({"k": np.arange(len(sums)), "s": sums})

        out = np.zeros(width + 2 * width * width)
        for r in rows.select("n", "v", "y").mapInPandas(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
            out[r["k"]] = r["s"]
        return out[:width], out[width : width + width**2].reshape(width, width), out[width + width**2 :].reshape(width, width)

    def turned(rows: DataFrame, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
        """Blocks whose v is (y - mean) @ turn."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"b": batch["b"], "v": [((_matrix(r.y, r.n) - mean) @ turn).tobytes() for r in batch.itertuples()]})

        return rows.select("b", "n", "y").mapInPandas(run, "b long, v binary")

    def orthogonal(sums: np.ndarray, gram: np.ndarray) -> np.ndarray:
        values, axes = np.linalg.eigh(gram - np.outer(sums, sums) / n)
        keep = values > 1e-26 * max(values[-1], 0)
        return axes * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)

    first = stored(own.join(own.select("b", "n").mapInPandas(start, "b long, v binary"), "b"))
    sums, gram, _ = moments(first.withColumn("y", F.col("v")))
    state = stored(own.join(turned(first.withColumn("y", F.col("v")), sums / n, orthogonal(sums, gram)), "b"))
    delete(spark, first.stored_at)
    before = np.zeros(parts)
    for _ in range(rounds):
        product = stored(state.join(_times(state, state, count, kernel), "b"))
        sums, gram, ritz = moments(product)
        values, axes = np.linalg.eigh((ritz + ritz.T) / 2)  # v is centred, so the centring of y doesn't matter here
        values, axes = values[::-1], axes[:, ::-1]
        kept = min(parts, width)
        done = np.abs(values[:kept] - before[:kept]).max() <= tolerance * max(values[0], 1e-300)
        before = values[:parts].copy()
        if done:
            final = turned(state.withColumn("y", F.col("v")), np.zeros(width), axes[:, :kept])
            out = stored(own.join(final, "b"))
            shift = (sums / n) @ axes[:, :kept]
            for x in (state, product, own):
                delete(spark, x.stored_at)
            return KernelComponents(kernel, out, count, np.maximum(values[:kept], 1e-300), shift)
        state = stored(own.join(turned(product, sums / n, orthogonal(sums, gram)), "b"), replaces=state)
        delete(spark, product.stored_at)
    raise RuntimeError(f"components not settled after {rounds} rounds")


@dataclass
class KernelMachine:
    """Landmarks, the map that makes their kernel's columns orthogonal, and the linear machine on what it gives."""

    kernel: Polynomial
    landmarks: np.ndarray
    turn: np.ndarray
    model: PipelineModel | None = None

    def mapped(self, df: DataFrame) -> DataFrame:
        """``df`` with ``features`` in the landmarks' space. Rows are compared with all landmarks in the task that holds them."""
        kernel, landmarks, turn = self.kernel, self.landmarks, self.turn

        @F.arrow_udf("array<double>")
        def place(features: pa.Array) -> pa.Array:
            x = features.flatten().to_numpy(zero_copy_only=False).reshape(-1, landmarks.shape[1])
            out = np.empty((len(x), turn.shape[1]))
            for k in range(0, len(x), BLOCK):
                out[k : k + BLOCK] = kernel(x[k : k + BLOCK], landmarks) @ turn
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

        return df.withColumn("features", place("features"))

    def predicted(self, df: DataFrame) -> DataFrame:
        """``df`` with ``predicted``."""
        done = learning.predicted(self.model, self.mapped(df.withColumn("_own", F.col("features"))))
        return done.withColumn("features", F.col("_own")).drop("_own")


def kernel_machine(
    train: DataFrame, key: str, kernel: Polynomial = Polynomial(), landmarks: int = LANDMARKS, rounds: int = 50, penalty: float = 0.01, seed: int = 42
) -> KernelMachine:
    """A machine with a polynomial kernel over (key, features, label), one class against the rest.

    Its decision is a weighted sum of kernels with ``landmarks`` rows, drawn by a hash of the key (a bounded number, held by the driver and
    sent to the tasks); the weights are fitted to all rows. For that, rows are placed in the space that the landmarks span, where the
    kernel is a scalar product, and a linear machine is trained there by Spark.
    """
    drawn = train.orderBy(tables.hash_order(key, seed), key).limit(landmarks).select("features").collect()
    points = np.array([r["features"] for r in drawn], np.float64)
    values, axes = np.linalg.eigh(kernel(points, points))
    keep = values > 1e-10 * values[-1]
    machine = KernelMachine(kernel, points, axes[:, keep] / np.sqrt(values[keep]))
    machine.model = learning.linear_svm(machine.mapped(train.select("features", "label")), rounds, penalty)
    return machine
