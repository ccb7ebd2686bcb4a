"""Comparing runs: evaluations (run, step, phase, family, correct), logs by step, nested metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import tables


def priority(value: Column, order: Sequence[str], other: int) -> Column:
    """The place of a value in a list of phases or sources, ``other`` for any that isn't named."""
    out = F.lit(other)
    for k, name in reversed(list(enumerate(order))):
        out = F.when(value == name, k).otherwise(out)
    return out


def latest_values(log: DataFrame, keys: Sequence[str], step: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The last value of several columns together: greatest step that isn't negative, then the later row, then the later column."""
    seen = [F.when(F.col(c).isNotNull() & (F.col(step) >= 0), F.struct(F.col(step).alias("s"), F.col(order).alias("o"), F.lit(k).alias("k"), F.col(c).cast("double").alias("v"))) for k, c in enumerate(columns)]
    best = seen[0] if len(seen) == 1 else F.greatest(*seen)
    return log.groupBy(*keys).agg(F.max(best).alias("_b")).select(*keys, F.col("_b.v").alias("value"))


def values_at_step(log: DataFrame, keys: Sequence[str], step: str, order: str, columns: Sequence[str]) -> DataFrame:
    """(keys, step, value): by step the first of ``columns`` that has any value, from the last row that has it."""
    last = [tables.last_by(c, order) for c in columns]
    return log.groupBy(*keys, step).agg(F.coalesce(*last).cast("double").alias("value"))


def rates(evaluations: DataFrame, keys: Sequence[str], correct: str = "correct", groups: DataFrame | None = None) -> DataFrame:
    """(keys, n, matches, percent) of a 0/1 column; a null counts as wrong. With ``groups`` (keys), each of them has a row,
    with 0 where it is empty."""
    n, matches = F.count("*"), F.coalesce(F.sum(F.col(correct).cast("long")), F.lit(0))
    found = evaluations.groupBy(*keys).agg(n.alias("n"), matches.alias("matches"), (100.0 * matches / n).alias("percent"))
    return found if groups is None else groups.select(*keys).distinct().join(found, list(keys), "left").fillna(0, ["n", "matches", "percent"])


def outcomes(df: DataFrame, status: Column, names: Sequence[str]) -> DataFrame:
    """One row: how many rows have each of the outcomes."""
    return df.agg(*(F.count_if(status == n).alias(n) for n in names))


def contrasts(value: Column, inside: Column, least: float = 1e-8) -> list[Column]:
    """Means of a value inside and outside of a mask, and their ratio."""
    a, b = F.avg(F.when(inside, value)), F.avg(F.when(~inside, value))
    return [a.alias("inside"), b.alias("outside"), (a / F.greatest(b, F.lit(least))).alias("ratio")]


def mean_iou(df: DataFrame, keys: Sequence[str], truth: str, logits: str, classes: int) -> DataFrame:
    """(keys, mean_iou): intersection over union of each class, averaged over those that occur; the prediction is the first
    largest logit."""
    guess = F.array_position(logits, F.array_max(logits)) - 1
    rows = df.select(*keys, F.col(truth).alias("_t"), guess.alias("_g"))
    both = [F.count_if((F.col("_t") == k) & (F.col("_g") == k)) for k in range(classes)]
    either = [F.count_if((F.col("_t") == k) | (F.col("_g") == k)) for k in range(classes)]
    found = rows.groupBy(*keys).agg(F.array(*(F.when(e > 0, b / e) for b, e in zip(both, either, strict=True))).alias("_i"))
    seen = F.array_compact("_i")
    return found.select(*keys, (F.aggregate(seen, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(seen), F.lit(0))).alias("mean_iou"))


def photometric(predicted: Column, truth: Column) -> Column:
    """How far two pictures' means and (population) deviations are apart, together."""
    return F.abs(F.avg(predicted) - F.avg(truth)) + F.abs(F.stddev_pop(predicted) - F.stddev_pop(truth))


def discovered(sources: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Records of one kind from several sources, the most trusted first: ``key``, ``sources`` (names that have it) and each
    other column's value from the first source in which it is not null."""
    names = [n for n, _ in sources]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("_source", F.lit(k)) for k, (_, df) in enumerate(sources)))
    others = [c for c in rows.columns if c not in (key, "_source")]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_source"))).alias(c) for c in others]
    seen = F.transform(F.array_sort(F.collect_set("_source")), lambda k: F.get(F.array(*map(F.lit, names)), k))
    return rows.groupBy(key).agg(seen.alias("sources"), *firsts)


def summary_row(config: Column, fields: Sequence[tuple[str, Sequence[str]]]) -> list[Column]:
    """Columns from a map of settings: of each field the first of its keys that is set; a missing one is null."""
    return [F.coalesce(*(F.try_element_at(config, F.lit(k)) for k in keys)).alias(name) for name, keys in fields]


def preferred(evaluations: DataFrame, keys: Sequence[str], phases: Sequence[str], order: str, other: int = 5) -> DataFrame:
    """One row a key: that of the most preferred phase, then the first by ``order``."""
    return tables.keep_first(evaluations, keys, [priority(F.col("phase"), phases, other), F.col(order)])


def run_points(evaluations: DataFrame) -> DataFrame:
    """(run, step, label): a run of several evaluated steps is one point a step, any other is one point without step."""
    steps = evaluations.groupBy("run").agg(F.count_distinct("step").alias("_n"))
    one = F.col("_n") <= 1
    joined = evaluations.join(steps, "run").select("run", F.when(~one, F.col("step")).alias("step"), "_n").distinct()
    label = F.when(one, F.col("run").cast("string")).otherwise(F.concat(F.col("run").cast("string"), F.lit("-step-"), F.col("step").cast("string")))
    return joined.select("run", "step", label.alias("label"))


def side_by_side(answers: DataFrame, key: str, runs: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """A row a key with the columns ``<run> <column>``; of repeated answers of a run the last one by ``order``."""
    picked = [
        F.max_by(c, F.when(F.col("run") == run, F.col(order))).alias(f"{run} {c}")  # max_by leaves out null orders
        for run in runs for c in columns
    ]
    return answers.groupBy(key).agg(*picked)


def metric_rows(metrics: DataFrame, keys: Sequence[str], total: str, by_family: str) -> DataFrame:
    """(keys, family, value) of a total column and a map by family; the total's family is ``all``."""
    families = F.coalesce(F.col(by_family), F.from_json(F.lit("{}"), "map<string,double>"))
    rows = F.concat(F.array(F.struct(F.lit("all").alias("key"), F.col(total).cast("double").alias("value"))), F.map_entries(families))
    return metrics.select(*keys, F.explode(rows).alias("_r")).select(*keys, F.col("_r.key").alias("family"), F.col("_r.value").alias("value"))


def missing_names(present: DataFrame, required: DataFrame, name: str) -> DataFrame:
    """Required names that are not there, each once."""
    return required.select(name).distinct().join(present.select(name), name, "left_anti")
