"""Signals as rows (series, i, v): spectra, alignment, resampling, gaps, runs, peaks, accumulators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import ordered


def long_series(df: DataFrame, key: str, array: str) -> DataFrame:
    return df.select(F.col(key).alias("series"), F.posexplode(array).alias("i", "x")).select("series", "i", F.col("x").cast("double").alias("v"))


def dft_magnitude(series: Column, bins: int) -> Column:
    """Magnitudes of the first ``bins`` Fourier coefficients of an array column, without leaving its row."""
    n = F.size(series)

    def part(k: Column, wave) -> Column:
        angle = lambda i: -2.0 * math.pi * k * i / n
        products = F.transform(series, lambda v, i: v * wave(angle(i)))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.sqrt(F.pow(part(k, F.cos), 2) + F.pow(part(k, F.sin), 2)))


def best_lag(predicted: Column, truth: Column, max_lag: int, least: int = 10) -> Column:
    """The lag at which two arrays, cut to one length and freed of their means, agree best: with lag k sample j of the
    prediction meets sample j + k of the truth.

    Lags with fewer than ``least`` pairs don't count; of equal sums of products the smallest lag wins; it is 0 if the arrays
    are shorter than ``least`` or no lag is allowed.
    """
    n = F.least(F.size(predicted), F.size(truth))

    def found(a: Column, b: Column) -> Column:
        def score(lag: Column) -> Column:
            overlap = n - F.abs(lag)
            x = F.slice(a, F.greatest(-lag, F.lit(0)) + 1, overlap)
            y = F.slice(b, F.greatest(lag, F.lit(0)) + 1, overlap)
            total = F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
            return F.when(overlap >= least, F.struct(total.alias("s"), (-lag).alias("l")))

        return F.array_max(F.transform(F.sequence(F.lit(-max_lag), F.lit(max_lag)), score))["l"]

    lag = -_with(_centred(F.slice(predicted, F.lit(1), n)), lambda a: _with(_centred(F.slice(truth, F.lit(1), n)), lambda b: found(a, b)))
    return F.when((n >= least) & (max_lag >= 1), F.coalesce(lag, F.lit(0))).otherwise(0)


def _with(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _centred(values: Column) -> Column:
    return _with(values, lambda v: _with(_total(v) / F.nullif(F.size(v), F.lit(0)), lambda m: F.transform(v, lambda x: x - m)))


def lead_details(df: DataFrame, keys: list[str], predicted: str, truth: str, rate: float, max_shift: float = 0.2) -> DataFrame:
    """(keys, lag, dc, rmse, sig_power, err_power, n) of each pair of arrays: aligned in time by ``best_lag``, then freed
    of their constant difference."""
    lag = best_lag(F.col(predicted), F.col(truth), int(round(max_shift * rate)))
    rows = df.select(*keys, predicted, truth, lag.alias("lag"), F.least(F.size(predicted), F.size(truth)).alias("_n"))
    n = F.col("_n") - F.abs("lag")
    cut = lambda c, s: F.slice(c, F.greatest(s, F.lit(0)) + 1, n)
    rows = rows.select(*keys, "lag", n.alias("n"), cut(predicted, -F.col("lag")).alias("_p"), cut(truth, F.col("lag")).alias("_t"))
    rows = rows.withColumn("dc", _total(F.zip_with("_t", "_p", lambda t, p: t - p)) / F.nullif("n", F.lit(0)))
    power = _total(F.zip_with("_t", "_p", lambda t, p: (p + F.col("dc") - t) * (p + F.col("dc") - t)))
    rows = rows.withColumn("err_power", power).withColumn("sig_power", _total(F.transform("_t", lambda t: t * t)))
    return rows.select(*keys, "lag", "dc", F.sqrt(F.col("err_power") / F.nullif("n", F.lit(0))).alias("rmse"), "sig_power", "err_power", "n")


def signal_to_noise_over_leads(details: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    """(keys, snr_db): powers are summed over the leads of a record before they are compared."""
    ratio = (F.sum("sig_power") + eps) / (F.sum("err_power") + eps)
    return details.groupBy(*keys).agg((10 * F.log10(ratio)).alias("snr_db"))


def signal_to_noise(truth: Column, predicted: Column, eps: float = 1e-12) -> Column:
    """10 log10 of signal power over error power."""
    return 10 * F.log10((F.sum(truth * truth) + eps) / (F.sum((truth - predicted) * (truth - predicted)) + eps))


def resampled(values: Column, size: int) -> Column:
    """An array stretched to ``size`` points by linear interpolation, end points held."""
    last = F.size(values) - 1

    def point(k: Column) -> Column:
        x = k * last / F.lit(max(1, size - 1))
        low = F.floor(x).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, last))
        return a + (b - a) * (x - low)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), point)


def resampled_at_rate(values: Column, source_rate: float, target_rate: float) -> Column:
    """An array at another rate, by linear interpolation; the source's is rounded, and beyond the last sample it is held."""
    source = round(source_rate)
    n = F.size(values)
    size = F.rint(n / source * target_rate).cast("int")

    def point(k: Column) -> Column:
        x = k * source / target_rate
        low = F.least(F.floor(x).cast("int"), n - 1)
        a, b = F.get(values, low), F.get(values, F.least(low + 1, n - 1))
        return a + (b - a) * (x - low)

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), point)).otherwise(F.array().cast("array<double>"))


def decoded_lead(centres: Column, baseline: Column, px_per_mm_x: float, px_per_mm_y: float, rate: float, mm_per_s: float = 25.0) -> Column:
    """A traced line (heights in pixels, one a column of the picture) as millivolts at a sampling rate."""
    mv = F.transform(centres, lambda y: values.pixel_to_mv(y, baseline, F.lit(float(px_per_mm_y))))
    return _with(mv, lambda v: resampled_at_rate(v, px_per_mm_x * mm_per_s, rate))


def expected_samples(lead: Column, rate: Column, rhythm: str = "II", long: float = 10.0, short: float = 2.5) -> Column:
    """Samples that a lead has: ten seconds of the rhythm lead, a quarter of that of any other."""
    return F.floor(rate * F.when(lead == rhythm, long).otherwise(short)).cast("long")


def gaps_filled(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``filled``: linear between the neighbours that have a value, the nearest one beyond the ends; null where a key has none."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    out = ordered.nearest_known(df, keys, order, known)
    share = (F.col(order) - F.col("before.o")) / (F.col("after.o") - F.col("before.o"))
    between = F.col("before.v") + (F.col("after.v") - F.col("before.v")) * share
    filled = F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.coalesce(between, "before.v", "after.v"))
    return out.withColumn("filled", filled).drop("after", "before")


def local_maxima(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows not below either neighbour; a missing neighbour does not count against a row."""
    high = lambda x: F.coalesce(F.col(value) >= x, F.lit(True))
    sides = {"_p": lambda w: F.lag(value).over(w), "_n": lambda w: F.lead(value).over(w)}
    out = ordered.over_neighbours(df, keys, [order], 1, sides)
    return out.where(high(F.col("_p")) & high(F.col("_n"))).drop("_p", "_n")


def runs_over(df: DataFrame, keys: list[str], order: str, over: Column, least: int) -> DataFrame:
    """(keys, first, last, n) of runs of at least ``least`` consecutive rows for which ``over`` holds."""
    marked = df.withColumn("_over", F.coalesce(over, F.lit(False)))
    changed = lambda w: (~F.col("_over").eqNullSafe(F.lag("_over").over(w))).cast("int")
    marked = ordered.running_sum(marked, keys, [order], changed, "_run").where("_over")
    runs = marked.groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("_run")


def moving(df: DataFrame, keys: list[str], order: str, value: Column, reach: int, how, name: str) -> DataFrame:
    """``df`` with an aggregate over the rows at most ``reach`` away."""
    return ordered.over_neighbours(df, keys, [order], reach, {name: lambda w: how(value).over(w.rowsBetween(-reach, reach))})


def spaced_peaks(df: DataFrame, key: str, position: str, score: str, gap: int) -> DataFrame:
    """(key, picks): positions by falling score (of equals the smallest), each at least ``gap`` from those before; an array of a key's picks."""
    chosen = ordered.spaced(df.select(key, position, score), [key], position, score, gap)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(position).cast("long").alias("p"))))
    return chosen.groupBy(key).agg(F.transform(ranked, lambda e: e["p"]).alias("picks"))


def hough_votes(points: DataFrame, angles: int, step: float) -> DataFrame:
    """(image, theta, rho, votes) of points (image, x, y): each point votes once for each of a fixed number of
    angles, and votes are counted before they move."""
    theta = F.col("theta") * F.lit(math.pi / angles)
    voted = points.withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))))
    rho = F.round((F.col("x") * F.cos(theta) + F.col("y") * F.sin(theta)) / step + 1e-7).cast("long")
    return voted.groupBy("image", "theta", rho.alias("rho")).agg(F.count("*").alias("votes"))
