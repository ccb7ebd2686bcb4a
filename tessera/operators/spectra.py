"""Spectra and filters of array columns: numpy over Arrow batches, signals of one length together, nothing shuffles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples that are transformed together.
SAMPLES = 1 << 18
_ARRAY = T.ArrayType(T.DoubleType())


def _stacked(columns: list[pd.Series], how) -> pd.Series:
    """``how`` of the matrices of all rows whose arrays have one length, a row a signal (nulls are NaN); null where an array is
    null, and where ``how`` gives None for that length."""
    rows: dict[tuple, list[int]] = {}
    for k, own in enumerate(zip(*columns, strict=True)):
        if all(v is not None for v in own):
            rows.setdefault(tuple(len(v) if isinstance(v, np.ndarray) else v for v in own), []).append(k)
    out: list = [None] * len(columns[0])
    for length, whole in rows.items():
        step = max(1, SAMPLES // max(1, *map(int, length)))
        for at in (whole[k : k + step] for k in range(0, len(whole), step)):
            found = how(*(np.stack([np.asarray(c.iloc[k], np.float64) for k in at]) for c in columns))
            if found is not None:
                for k, v in zip(at, found, strict=True):
                    out[k] = v
    return pd.Series(out, dtype=object)


def _each(how, kind: T.DataType = _ARRAY):
    """A function of stacked signals (rows by samples) as a function of an array column."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return _stacked([values], how)

    return lambda column: run(column.cast("array<double>"))


def magnitudes(values: Column, bins: int = 1000) -> Column:
    """Magnitudes of the first ``bins`` Fourier coefficients, padded with 0 where the signal is shorter."""

    found = _each(lambda v: np.abs(np.fft.fft(v))[:, :bins] if v.shape[1] else v)(values)  # padded by Spark, so that Python holds no padding
    return F.concat(found, F.array_repeat(F.lit(0.0), F.lit(bins) - F.size(found)))


def positive_spectrum(values: Column) -> Column:
    """Magnitudes of the coefficients of frequencies from 0 up to (not including) half the rate."""
    return _each(lambda v: np.abs(np.fft.fft(v))[:, : (v.shape[1] + 1) // 2] if v.shape[1] else v)(values)


def positive_frequencies(size: Column, rate: float) -> Column:
    """The frequencies of ``positive_spectrum``."""
    top = F.floor((size + 1) / 2).cast("int")
    return F.when(top > 0, F.transform(F.sequence(F.lit(0), F.greatest(top - 1, F.lit(0))), lambda k: k * rate / size)).otherwise(F.array().cast("array<double>"))


def envelope(values: Column) -> Column:
    """The magnitude of the analytic signal: negative frequencies are cancelled and positive ones doubled."""

    def how(v: np.ndarray) -> np.ndarray:
        n = v.shape[1]
        if not n:
            return v
        keep = np.zeros(n)
        keep[0] = 1
        keep[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            keep[n // 2] = 1
        return np.abs(np.fft.ifft(np.fft.fft(v) * keep))

    return _each(how)(values)


def low_pass_coefficients(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth low-pass; ``cutoff`` as a share of half the rate. By the bilinear transform."""
    warped = 2 * math.tan(math.pi * cutoff / 2)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    digital = (2 + poles) / (2 - poles)
    a = np.real(np.poly(digital))
    b = np.poly(-np.ones(order))
    return b * a.sum() / b.sum(), a


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The difference equation of (b, a) along the last axis, from an initial state; signals of one length go step by step together."""
    z, out = np.zeros((*x.shape[:-1], len(a))), np.empty(x.shape)
    z[..., :-1] = state
    for k in range(x.shape[-1]):
        out[..., k] = b[0] * x[..., k] + z[..., 0]
        z[..., :-1] = b[1:] * x[..., k, None] + z[..., 1:] - a[1:] * out[..., k, None]
    return out


def low_passed(values: Column, cutoff: float, rate: float, order: int = 3) -> Column:
    """A Butterworth low-pass run forward and backward, so that nothing is delayed. The ends are continued by point
    reflection; a signal too short for that (9 samples or fewer for order 2, 12 for 3) is null."""
    b, a = low_pass_coefficients(order, cutoff / (rate / 2))
    steady = np.linalg.solve(np.eye(order) - np.array([[-a[i + 1] * (j == 0) + (j == i + 1) for j in range(order)] for i in range(order)]), b[1:] - a[1:] * b[0])
    edge = 3 * (order + 1)

    def how(v: np.ndarray) -> np.ndarray | None:
        if v.shape[1] <= edge:
            return None
        x = np.concatenate([2 * v[:, :1] - v[:, edge:0:-1], v, 2 * v[:, -1:] - v[:, -2 : -edge - 2 : -1]], axis=1)
        for _ in range(2):
            x = filtered(b, a, x, steady * x[:, :1])[:, ::-1]
        return x[:, edge:-edge]

    return _each(how)(values)


def spectrogram_db(values: Column, frame: int = 2048, hop: int = 512, range_db: float = 80.0) -> Column:
    """Frames of magnitudes in decibels below the largest, ``range_db`` at most. Frames are centred on every ``hop``-th
    sample of the signal (0 beyond its ends) under a periodic Hann window."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)

    def how(v: np.ndarray) -> list:
        if not v.shape[1]:
            return [[] for _ in v]
        padded = np.pad(v, ((0, 0), (frame // 2, frame // 2)))
        starts = np.arange(0, padded.shape[1] - frame + 1, hop)
        found = np.abs(np.fft.rfft(padded[:, starts[:, None] + np.arange(frame)] * window))
        top = found.max(axis=(1, 2), keepdims=True)
        level = 20 * np.log10(np.maximum(found, 1e-5)) - 20 * np.log10(np.maximum(top, 1e-5))
        return [list(x) for x in np.maximum(level, level.max(axis=(1, 2), keepdims=True) - range_db)]

    return _each(how, T.ArrayType(_ARRAY))(values)


def wiener_restored(clean: Column, inked: Column, page: Column, width: Column, k: float = 1e-3) -> Column:
    """A page filtered by what turns an inked picture into a clean one, clipped to [0, 1].

    All three are pictures of one size, as arrays of rows of ``width`` pixels; the filter is estimated from the pair.
    """

    @F.pandas_udf(_ARRAY)
    def run(clean: pd.Series, inked: pd.Series, page: pd.Series, width: pd.Series) -> pd.Series:
        def how(c: np.ndarray, i: np.ndarray, p: np.ndarray, w: np.ndarray) -> np.ndarray:
            x, y, z = (np.fft.fft2(v.reshape(len(v), -1, int(w[0]))) for v in (c, i, p))
            return np.clip(np.fft.ifft2(x * np.conj(y) / (np.abs(y) ** 2 + k) * z).real, 0, 1).reshape(len(c), -1)

        return _stacked([clean, inked, page, width], how)

    return run(*(x.cast("array<double>") for x in (clean, inked, page)), width)
