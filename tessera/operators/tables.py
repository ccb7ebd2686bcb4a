"""Table operators: projections by prefix or position, set differences, keyed upserts, keep-first rows, top-k."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import durable


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    """All columns but the keys with a prefix."""
    return df.select(*(F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns))


def reindexed(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Exactly these columns in this order; missing ones are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns))


def ordered_case(rules: Sequence[tuple[Column, Column]]) -> Column:
    """The value of the last rule that holds, as if each rule were an assignment."""
    out = F.lit(None)
    for condition, value in rules:
        out = F.when(condition, value).otherwise(out)
    return out


def one_hot(column: str, codes: Sequence) -> list[Column]:
    return [(F.col(column) == code).cast("int").alias(f"{column}_{code}") for code in codes]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``; null keys are equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: Column | int, shares: int = 32) -> DataFrame:
    """The first ``n`` rows of each group; ``n`` may be a column that differs by group. Shares of a group are cut
    to ``n`` rows first, so that a large group is not sorted in one task unless its ``n`` is large."""
    share = F.pmod(F.monotonically_increasing_id(), F.lit(shares))  # any will do: the result doesn't depend on it
    first = Window.partitionBy(*keys, "_share").orderBy(*order)
    cut = df.withColumn("_share", share).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn", "_share")


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose key (nulls equal) is not in ``new``, and all new rows."""
    fresh = new.select(*(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return stored.join(fresh, same, "left_anti").unionByName(new, allowMissingColumns=True)


def hash_order(key: str, seed: int = 42) -> Column:
    """A reproducible random order, the same in every engine that has md5."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def last_by(value: str, *order: str) -> Column:
    """The value of the row that comes last by ``order``; null values do not count."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def grouped_with_total(df: DataFrame, key: str, aggs: Sequence[Column], label: str = "all") -> DataFrame:
    """Aggregates by key and over all rows in one pass; the total is labelled by grouping(), not by null."""
    return (
        df.groupingSets([[], [key]], key)
        .agg(F.grouping(key).alias("_g"), *aggs)
        .withColumn(key, F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(key)))
        .drop("_g")
    )


def merged(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls match nulls; the keys stand once, from the left."""
    other = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, same, how).drop(*(f"_r_{k}" for k in keys))


def sized(values: Column, size: int) -> Column:
    """An array of exactly ``size`` numbers: cut, or padded with 0. Null counts as empty."""
    values = F.coalesce(values, F.array().cast("array<double>"))
    return F.concat(F.slice(values, 1, size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(values), F.lit(0))))


def spacing(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, median_gap): exact median of the steps between neighbours, null for a single row."""
    from tessera.operators import ordered  # which builds on this module

    gaps = ordered.over_neighbours(df.select(*keys, order), keys, [order], 1, {"_before": lambda w: F.lag(order).over(w)})
    return ordered.quantiles(gaps.withColumn("_gap", F.col(order) - F.col("_before")), keys, "_gap", {"median_gap": 0.5})


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by columns whose values together are distinct, however large ``n`` is; of a few ``orderBy`` and ``limit`` will do.

    Rows are range-partitioned; whole partitions are taken, and only the one in which the cut lies is ranked.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    left, whole, cut = n, [], (-1, 0)
    for r in sorted(ranged.groupBy("_part").count().collect()):  # a row a partition
        if r["count"] > left:
            cut = (r["_part"], left)
            break
        whole.append(r["_part"])
        left -= r["count"]
    rest = ranged.where(F.col("_part") == cut[0])
    ranked = rest.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return ranged.where(F.col("_part").isin(whole)).unionByName(ranked.where(F.col("_rn") <= cut[1]).drop("_rn")).drop("_part")


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` (few) rows by the order, in it."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(n).orderBy(*order)


def renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns with new names, by position; there must be as many."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def at_positions(df: DataFrame, places: Sequence[int] | slice) -> DataFrame:
    """The columns at these positions, negative ones counted from the end."""
    columns = df.columns[places] if isinstance(places, slice) else [df.columns[k] for k in places]
    return df.select(*(F.col(f"`{c}`") for c in columns))


def strict_int(column: str) -> Column:
    """An int; a null is an error, and so is text that is none under ANSI rules."""
    return F.when(F.col(column).isNull(), F.raise_error(F.lit(f"null in {column}")).cast("int")).otherwise(F.col(column).cast("int"))


def side_by_key(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Frames side by side, one row for each key in any of them; keys are distinct and not null within a frame."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), frames)


def sorted_set(column: str, separator: str = ", ") -> Column:
    """The distinct values of a group (few) as sorted text."""
    return F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), separator)


def first_of_group(column: str, *order: str) -> Column:
    """The value of the group's first row by ``order``, null values counted too."""
    return F.min_by(F.struct(column), F.struct(*order))[column]


def holdout(df: DataFrame, key: str, fraction: float, seed: int = 42, least: int = 0) -> DataFrame:
    """``df`` with ``held``: ``ceil(fraction * rows)`` rows, at least ``least`` and at most all but one, drawn by a hash of a distinct key."""
    rows = df.count()
    n = max(0, min(max(math.ceil(fraction * rows), least), rows - 1))
    drawn = first_rows(df.select(key).withColumn("_h", hash_order(key, seed)), ["_h", key], n).select(key, F.lit(True).alias("held"))
    return df.join(drawn, key, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def weighted_choice(draw: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """The category in whose share of the weights a number in [0, 1) falls."""
    total, reached, out = sum(w for _, w in weights), 0.0, []
    for name, w in weights:
        reached += w
        out.append((reached / total, name))
    choice = F.lit(out[-1][1])
    for edge, name in reversed(out[:-1]):
        choice = F.when(draw < edge, name).otherwise(choice)
    return choice


def first_available(choices: Column, available: Column, otherwise: str) -> Column:
    """The first of an array of choices that is among the available ones, else the fallback."""
    return F.coalesce(F.get(F.filter(choices, lambda c: F.array_contains(available, c)), F.lit(0)), F.lit(otherwise))


def uniform(key: Column, salt: str) -> Column:
    """A reproducible number in [0, 1) for each key: 52 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|" + salt))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def drawn_by_weight(df: DataFrame, keys: Sequence[str], weight: str, draw: DataFrame, order: str) -> DataFrame:
    """One row of each group, drawn with a chance in proportion to its weight: the first by ``order`` at which the running
    sum passes ``u`` (keys, u: a number in [0, 1)) of the total. Groups are windows: images or the like."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = df.withColumn("_run", F.sum(weight).over(w)).withColumn("_all", F.sum(weight).over(Window.partitionBy(*keys)))
    passed = run.join(draw, list(keys)).where(F.col("_run") > F.col("u") * F.col("_all"))
    return passed.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def flattened(df: DataFrame, sections: str, prefixes: dict[str, str], renames: dict[str, str]) -> DataFrame:
    """(other columns, key, value) of a map of maps: a section's prefix (none if not named) before its keys, then renamed."""
    others = [c for c in df.columns if c != sections]
    rows = df.select(*others, F.explode(sections).alias("_s", "_m")).select(*others, "_s", F.explode("_m").alias("_k", "value"))
    lookup = lambda table, at, other: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), at), other) if table else other
    key = F.concat(lookup(prefixes, F.col("_s"), F.lit("")), F.col("_k"))
    return rows.select(*others, lookup(renames, key, key).alias("key"), "value")


def widened(df: DataFrame, column: str, size: int, prefix: str) -> DataFrame:
    """The first ``size`` elements of an array as columns ``<prefix>0``, ``<prefix>1``, ...; missing ones are null."""
    return df.select(*(c for c in df.columns if c != column), *(F.get(column, F.lit(k)).alias(f"{prefix}{k}") for k in range(size)))


def renewed(expected: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Expected keys without a valid item: what has to be made (again)."""
    return expected.select(key).distinct().join(valid.select(key), key, "left_anti")
