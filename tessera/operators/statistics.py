"""Descriptive statistics: correlations, scores, histograms, percentiles, agreement of predictions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ordered


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of the rows where both are present; null without variance."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of every unordered pair, in one aggregation over the table."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*(correlation(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.r")


def highly_correlated(matrix: DataFrame, least: float) -> DataFrame:
    """Columns that correlate with another one by more than ``least``."""
    hits = matrix.where((F.col("a") != F.col("b")) & (F.abs("r") > least))
    return hits.select(F.explode(F.array("a", "b")).alias("column_name")).distinct()


def scored(df: DataFrame, columns: Sequence[str], kind: str = "sample") -> DataFrame:
    """``<column>_z``: (x - mean) / deviation over the whole table. The one-row summary is joined by broadcast."""
    deviation = F.stddev_samp if kind == "sample" else F.stddev_pop
    summary = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(deviation(c).alias(f"_s_{c}") for c in columns))
    out = df.join(F.broadcast(summary))
    for c in columns:
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)))
    return out.drop(*summary.columns)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """``<column>_unit`` in [0, 1]; 0 where all values are the same."""
    summary = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    unit = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.join(F.broadcast(summary)).withColumn(f"{column}_unit", unit).drop("_lo", "_hi")


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values by upper-cased text, nulls last. They are numbered over range partitions, however many there are."""
    keys = df.select(column).distinct().withColumn("_null", F.col(column).isNull()).withColumn("_upper", F.upper(F.col(column).cast("string")))
    return ordered.ranked(keys, [], ["_null", "_upper", column]).select(column, F.col("_rank").alias("code"))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values' places in order, from 0, numbered over range partitions. Nulls have none."""
    keys = df.where(F.col(column).isNotNull()).select(column).distinct()
    return ordered.ranked(keys, [], [column]).select(column, F.col("_rank").alias("code"))


def histogram(df: DataFrame, bin_column: str, bins: int) -> DataFrame:
    """(bin, n, cdf) of integer bins 0 to bins - 1, empty ones included."""
    counted = df.groupBy(F.col(bin_column).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    full = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())
    running = F.sum("n").over(Window.orderBy("bin"))  # as many rows as bins
    return full.withColumn("cdf", F.when(total > 0, running / total).otherwise(0.0))


def matching_levels(source: DataFrame, reference: DataFrame) -> DataFrame:
    """(bin, level): the smallest reference bin whose cdf reaches the source's, else the last. Rows are bins."""
    last = reference.agg(F.max("bin").alias("_last"))
    ref = reference.select(F.col("bin").alias("level"), F.col("cdf").alias("ref_cdf"))
    found = source.join(F.broadcast(ref), F.col("ref_cdf") >= F.col("cdf") - 1e-12, "left").groupBy("bin").agg(F.min("level").alias("level"))
    return found.join(F.broadcast(last)).select("bin", F.coalesce("level", "_last").alias("level"))


def confusion(df: DataFrame, truth: str, predicted: str, labels: Sequence) -> DataFrame:
    """A row per label with the counts of each predicted label."""
    return df.groupBy(truth).agg(*(F.count_if(F.col(predicted) == x).alias(f"p_{x}") for x in labels))


def mask_scores(truth: Column, predicted: Column) -> list[Column]:
    """Precision, recall and intersection over union of two boolean columns."""
    tp, fp, fn = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~predicted)
    one = F.lit(1)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        (tp / F.greatest(tp + fp, one)).alias("prec"), (tp / F.greatest(tp + fn, one)).alias("rec"), (tp / F.greatest(tp + fp + fn, one)).alias("iou"),
    ]
