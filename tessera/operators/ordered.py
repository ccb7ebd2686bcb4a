"""Order within keys where a key may hold most of the rows: ranks, windows, carried values, quantiles, spaced choices.

Rows are range-partitioned by key and order, so that a large key lies in several tasks. Each partition's counts by key,
a small table, give every row its rank within its key; blocks of BLOCK ranks then are the windows, with as many
rows of their neighbours as a window reaches, and what a block hands on to those behind it is a row a block. Null keys
are a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import tables
from tessera.session import delete, stored

#: Rows of a key that are ordered together in one task.
BLOCK = 1 << 17


def _ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows in range partitions by these columns, stored, with ``_part``."""
    return stored(df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which nulls match."""
    return tables.merged(left, right, list(keys))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_rank``: the row's place within its key from 0. The order's values should be distinct within a key;
    rows that tie are ranked in any order. The ranges stay in the shared folder, as the result reads them."""
    ranges = _ranges(df, [*keys, *order])
    counts = ranges.groupBy(*keys, "_part").agg(F.count("*").alias("_m"))
    ahead = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    counts = counts.select(*keys, "_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    rows = _joined(ranges.withColumn("_place", place), counts, [*keys, "_part"])
    return rows.withColumn("_rank", F.col("_ahead") + F.col("_place")).drop("_ahead", "_place", "_part")


def blocked(df: DataFrame, reach: int = 0, block: int | None = None) -> DataFrame:
    """Ranked rows with their ``_block``, and copies (``_own`` false) for the blocks whose rows are at most ``reach`` ranks away."""
    size = block or BLOCK
    if reach > size:
        raise ValueError("a window reaches over more than a block")
    own = F.floor(F.col("_rank") / size)
    at = F.col("_rank") - own * size
    blocks = F.array(own, F.when((at < reach) & (own > 0), own - 1), F.when(at >= size - reach, own + 1)) if reach else F.array(own)
    out = df.withColumn("_block", F.explode(F.filter(blocks, lambda b: b.isNotNull())))
    return out.withColumn("_own", F.col("_block") == own)


def over_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int, columns: dict[str, Callable], block: int | None = None) -> DataFrame:
    """``df`` with a column for each function of a window by order that looks at most ``reach`` rows before or behind."""
    w = Window.partitionBy(*keys, "_block").orderBy("_rank")
    rows = blocked(ranked(df, keys, order), reach, block)
    return rows.withColumns({name: of(w) for name, of in columns.items()}).where("_own").drop("_rank", "_block", "_own")


def _handed_on(rows: DataFrame, keys: Sequence[str], summary: dict[str, Column], over: dict[str, Callable]) -> DataFrame:
    """Rows with what the blocks of their key say of themselves (``summary``, a row a block), seen from their own block."""
    w = Window.partitionBy(*keys).orderBy("_block")
    told = rows.groupBy(*keys, "_block").agg(*(c.alias(n) for n, c in summary.items()))
    told = told.select(*keys, "_block", *(of(w).alias(n) for n, of in over.items()))
    return _joined(rows, told, [*keys, "_block"])


def nearest_known(df: DataFrame, keys: Sequence[str], order: str, known: Column, block: int | None = None) -> DataFrame:
    """``df`` with ``before`` and ``after``: ``known`` (a struct, null where nothing is known) of the nearest row at or before, and at
    or behind each row by the order, across all rows of its key."""
    rows = blocked(ranked(df.withColumn("_known", known), keys, [order]), 0, block)
    w = Window.partitionBy(*keys, "_block").orderBy("_rank")
    rows = rows.withColumn("before", F.last("_known", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.first("_known", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    there = F.col("_known").isNotNull()
    summary = {"_first": F.min_by("_known", F.when(there, F.col("_rank"))), "_last": F.max_by("_known", F.when(there, F.col("_rank")))}
    rows = _handed_on(rows, keys, summary, {
        "_earlier": lambda v: F.last("_last", True).over(v.rowsBetween(Window.unboundedPreceding, -1)),
        "_later": lambda v: F.first("_first", True).over(v.rowsBetween(1, Window.unboundedFollowing)),
    })
    rows = rows.withColumn("before", F.coalesce("before", "_earlier")).withColumn("after", F.coalesce("after", "_later"))
    return rows.drop("_known", "_rank", "_block", "_own", "_earlier", "_later")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Callable, name: str, reach: int = 1, block: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` (a function of a window by order, whole numbers) over the rows of the key up to each row."""
    w = Window.partitionBy(*keys, "_block").orderBy("_rank")
    rows = blocked(ranked(df, keys, order), reach, block).withColumn("_v", value(w)).where("_own")
    rows = rows.withColumn(name, F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _handed_on(rows, keys, {"_sum": F.sum("_v")}, {"_ahead": lambda v: F.sum("_sum").over(v.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce("_ahead", F.lit(0))).drop("_rank", "_block", "_own", "_v", "_ahead")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], block: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` with the same key whose ``order`` is not greater; null without one.

    Of right rows with equal order any counts, so they should be distinct; left rows may repeat. A null order meets nothing.
    """
    none = [F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in columns]
    rows = left.select("*", F.lit(True).alias("_left"), *none)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in (*keys, order)]
    other = right.where(F.col(order).isNotNull()).select(*keys, order, *empty, F.lit(False).alias("_left"), *(F.col(c).alias(f"_r_{c}") for c in columns))
    both = rows.unionByName(other.select(*rows.columns)).withColumn("_at", F.struct(order, "_left"))
    known = F.when(~F.col("_left"), F.struct(*(f"_r_{c}" for c in columns)))
    found = nearest_known(both, keys, "_at", known, block).where("_left")
    return found.select(*left.columns, *(F.col(f"before._r_{c}").alias(c) for c in columns))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column a share) exact quantiles with linear interpolation; null for keys without a value.

    Distinct values are counted first and then lie in range partitions; the partitions' counts tell in which one each wanted rank lies, and
    only those are put in order. No task holds a key's values, however large the key is.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_n"))
    ranges = _ranges(counted, [*keys, "_v"])
    counts = ranges.groupBy(*keys, "_part").agg(F.sum("_n").alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")  # a row a partition
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("_all", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    place = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    ends = [F.struct(F.lit(f"{name}|{e}").alias("name"), how(place(p)).alias("rank")) for name, p in shares.items() for e, how in (("low", F.floor), ("high", F.ceil))]
    wanted = counts.withColumn("_w", F.explode(F.array(*ends))).where((F.col("_w.rank") >= F.col("_ahead")) & (F.col("_w.rank") < F.col("_ahead") + F.col("_m")))
    wanted = wanted.select(*keys, "_part", F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_ahead")).alias("_rank"))
    rows = _joined(ranges, wanted.select(*keys, "_part").distinct(), [*keys, "_part"])
    reached = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    hits = _joined(rows.withColumn("_to", reached), wanted, [*keys, "_part"]).where("_rank < _to AND _rank >= _to - _n")
    low_high = [F.max(F.when(F.col("_name") == f"{n}|{e}", F.col("_v"))).alias(f"{n}|{e}") for n in shares for e in ("low", "high")]
    sizes = counts.groupBy(*keys).agg(F.max("_all").alias("_all"))
    found = hits.groupBy(*keys).agg(*low_high)
    out = tables.merged(sizes, found, keys, "left") if keys else sizes.join(found)

    def interpolated(name: str, p: float) -> Column:
        low, high, at = F.col(f"`{name}|low`"), F.col(f"`{name}|high`"), place(p)
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return out.select(*keys, *(interpolated(n, p).alias(n) for n, p in shares.items()))


def median_deviations(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median, mad): exact medians of the values and of their distances from it."""
    middle = quantiles(df, keys, value, {"median": 0.5})
    away = _joined(df, middle, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return _joined(middle, quantiles(away, keys, "_d", {"mad": 0.5}), keys)


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, mean, std, low, high, median) of number columns; the deviation is the sample's. Null where a column has no value."""
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))
    rows = df.select(F.inline(cells))
    stats = rows.groupBy("name").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    return _joined(stats, quantiles(rows, ["name"], "v", {"median": 0.5}), ["name"])


def spaced(
    df: DataFrame, keys: Sequence[str], position: str, score: str, gap: int, count: int | None = None, refill: bool = False, forced: DataFrame | None = None
) -> DataFrame:
    """Rows of ``df`` chosen by falling score (of equals the smaller position first), each at least ``gap`` from those of its key chosen before.

    The same rows as by going through a key's rows one by one, but in rounds over all keys at once: a row that is the best within its
    gap is chosen and silences those within it. The best row of each stretch of ``gap`` positions asks the three stretches around it, so
    a round is a few joins of the rows that are left, spread by stretches. Rows of ``forced`` (keys, position) are
    chosen before all others, whatever lies between them. With ``count`` only a key's first so many are kept, forced ones first; ``refill`` makes
    up for missing ones by the best of the others. Positions are whole numbers, distinct within a key; rows without position or score are left
    out. A key of steadily rising scores takes a round for each choice.
    """
    spark, keys = df.sparkSession, list(keys)
    at = [*keys, "_p"]
    rows = df.where(F.col(position).isNotNull() & F.col(score).isNotNull()).withColumn("_p", F.col(position).cast("long"))
    rows = rows.withColumn("_s", F.struct(F.col(score).alias("s"), (-F.col("_p")).alias("p"))).withColumn("_c", F.floor(F.col("_p") / gap))
    rows = stored(rows)
    live = rows.select(*at, "_s", "_c")
    around = F.explode(F.array(*((F.col("_c") + k) for k in (-1, 0, 1)))).alias("_c")

    def within(some: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of some rows (columns named _a_) and the others within their gap, themselves too."""
        asking = some.select(*keys, F.col("_p").alias("_a_p"), F.col("_s").alias("_a_s"), around)
        return _joined(others, asking, [*keys, "_c"]).where(F.abs(F.col("_p") - F.col("_a_p")) < gap)

    def anti(left: DataFrame, right: DataFrame) -> DataFrame:
        gone = right.select(*(F.col(c).alias(f"_g_{c}") for c in at)).distinct()
        return left.join(gone, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in at], "left_anti")

    chosen = []
    last = None
    if forced is not None:
        first = _joined(rows, forced.select(*keys, F.col(position).cast("long").alias("_p")).distinct(), at).select(*at, "_s", "_c")
        first = stored(first)
        chosen.append(first)
        live = last = stored(anti(live, within(first, live)))
    while True:
        best = live.groupBy(*keys, "_c").agg(F.max("_s").alias("_s")).withColumn("_p", -F.col("_s.p"))
        beaten = within(best, live).where(F.col("_s") > F.col("_a_s")).select(*keys, F.col("_a_p").alias("_p"))
        winners = stored(anti(best, beaten).select(*at, "_s", "_c"))
        if winners.isEmpty():
            delete(spark, winners.stored_at)
            break
        chosen.append(winners)
        live = last = stored(anti(live, within(winners, live)), replaces=last)
    tiers = [w.select(*at, F.lit(0 if forced is not None and k == 0 else 1).alias("_tier")) for k, w in enumerate(chosen)]
    picks = tiers[0] if tiers else rows.limit(0).select(*at, F.lit(1).alias("_tier"))
    for more in tiers[1:]:
        picks = picks.unionByName(more)
    found = tables.merged(rows, picks, at, "left" if refill else "inner").withColumn("_tier", F.coalesce("_tier", F.lit(2)))
    if count is not None:
        found = tables.top_per_group(found, keys, [F.col("_tier"), F.col("_s").desc()], count).drop("_rn")
    found = stored(found.select(*df.columns))
    for done in (rows, *chosen, *([last] if last is not None else [])):
        delete(spark, done.stored_at)
    return found
