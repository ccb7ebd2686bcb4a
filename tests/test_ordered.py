"""Order within keys over several tasks: quantiles, windows, carried values and spaced choices against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered, signals, tables


@pytest.fixture
def blocks(monkeypatch):
    """Blocks of seven rows, so that each key of the tests lies in many."""
    monkeypatch.setattr(ordered, "BLOCK", 7)


@pytest.fixture(scope="module")
def series(spark):
    """Keys of 90, 1 and 20 rows, one of them null; values with gaps at the ends, in the middle and over whole blocks."""
    rng = random.Random(4)
    rows = []
    for key, n in (("long", 90), ("one", 1), (None, 20), ("empty", 9)):
        at = sorted(rng.sample(range(300), n))
        for k, t in enumerate(at):
            known = key != "empty" and not (k < 9 or 30 <= k < 55 or k > n - 4) if n > 1 else True
            rows.append((key, t, float(rng.randrange(12)) if known and rng.random() < 0.7 else None))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, t int, v double").repartition(6)


def by_key(rows):
    out = {}
    for k, t, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])):
        out.setdefault(k, []).append((t, v))
    return out


def test_gaps_filled_across_blocks(blocks, series):
    rows, df = series
    got = {(r.k, r.t): r.filled for r in signals.gaps_filled(df, ["k"], "t", "v").collect()}
    for k, own in by_key(rows).items():
        known = [(t, v) for t, v in own if v is not None]
        for t, _ in own:
            want = float(np.interp(t, *zip(*known, strict=True))) if known else None
            assert got[k, t] == (want if want is None else pytest.approx(want))
    assert len(got) == len(rows)


def test_maxima_moving_and_runs_across_blocks(blocks, series):
    rows, df = series
    whole = [(k, t, v or 0.0) for k, t, v in rows]
    df = df.fillna(0.0, ["v"])
    tops = {(r.k, r.t) for r in signals.local_maxima(df, ["k"], "t", "v").collect()}
    spread = {(r.k, r.t): r.m for r in signals.moving(df, ["k"], "t", F.col("v"), 5, F.max, "m").collect()}
    runs = sorted(((r.k or "", r.first, r.last, r.n) for r in signals.runs_over(df, ["k"], "t", F.col("v") > 2, 2).collect()))
    want = []
    for k, own in by_key(whole).items():
        v = [x for _, x in own]
        for i, (t, x) in enumerate(own):
            assert ((k, t) in tops) == (x >= max(v[max(0, i - 1) : i + 2]))
            assert spread[k, t] == max(v[max(0, i - 5) : i + 6])
        start = None
        for i in range(len(v) + 1):
            if i < len(v) and v[i] > 2:
                start = i if start is None else start
            elif start is not None:
                if i - start >= 2:
                    want.append((k or "", own[start][0], own[i - 1][0], i - start))
                start = None
    assert runs == sorted(want) and len(want) > 3
    with pytest.raises(ValueError):
        signals.moving(df, ["k"], "t", F.col("v"), 8, F.max, "m")
    assert signals.local_maxima(df.limit(0), ["k"], "t", "v").count() == 0


def test_as_of_across_blocks(blocks, spark, series):
    rows, left = series
    rng = random.Random(9)
    right = [(rng.choice(["long", None, "other"]), t, f"r{t}") for t in rng.sample(range(300), 60)]
    right += [(k, t, None if t % 2 else "same") for k, t, _ in rows[:10] if all(x[:2] != (k, t) for x in right)]
    df = spark.createDataFrame([*right, ("long", None, "never")], "k string, t int, w string")
    found = ordered.as_of(left.union(left.where("k IS NULL")), df, ["k"], "t", ["w"]).collect()
    assert len(found) == len(rows) + 20 and found[0].__fields__ == ["k", "t", "v", "w"]
    for r in found:
        before = [x for x in right if x[0] == r.k and x[1] <= r.t]
        assert r.w == (max(before, key=lambda x: x[1])[2] if before else None)


def test_ranks_of_a_key_in_several_tasks(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % 1009).alias("t"))
    got = sorted((r.t, r._rank) for r in ordered.ranked(df, ["k"], ["t"]).collect())
    assert [r for _, r in got] == list(range(1000))


def test_quantiles_against_numpy(spark):
    rng = random.Random(2)
    rows = [("most", rng.choice([float(rng.randrange(50)), rng.gauss(0, 1e6), 1e300 * rng.random()])) for _ in range(3000)]
    rows += [("few", 3.0), ("few", None), ("few", 4.0), ("one", -1.5), (None, 2.0), (None, 9.0), ("none", None)]
    shares = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "high": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in ordered.quantiles(df, ["k"], "v", shares).collect()}
    exact = {r.k: r for r in df.groupBy("k").agg(*(F.percentile("v", p).alias(n) for n, p in shares.items())).collect()}
    assert set(got) == {"most", "few", "one", None, "none"}
    for k in got:
        own = [v for x, v in rows if x == k and v is not None]
        for n, p in shares.items():
            assert got[k][n] == exact[k][n]
            assert got[k][n] == (pytest.approx(float(np.quantile(own, p)), rel=1e-12) if own else None)
    whole = ordered.quantiles(df, [], "v", {"mid": 0.5}).collect()
    assert [r.mid for r in whole] == [float(np.median([v for _, v in rows if v is not None]))]
    mad = {r.k: (r.median, r.mad) for r in ordered.median_deviations(df.where("k = 'few' OR k = 'one' OR k IS NULL"), ["k"], "v").collect()}
    assert mad == {"few": (3.5, 0.5), "one": (-1.5, 0.0), None: (5.5, 3.5)}
    assert ordered.quantiles(df.limit(0), ["k"], "v", shares).count() == 0


def test_described_columns(spark):
    df = spark.createDataFrame([(1, 2.0, None), (5, None, None), (3, 8.0, None)], "a int, b double, c double")
    got = {r["name"]: r for r in ordered.described(df, ["a", "b", "c"]).collect()}
    assert (got["a"]["mean"], got["a"]["std"], got["a"]["median"], got["a"]["low"], got["a"]["high"]) == (3.0, 2.0, 3.0, 1.0, 5.0)
    assert got["b"]["median"] == 5.0 and math.isclose(got["b"]["std"], math.sqrt(18)) and got["c"]["median"] is None and got["c"]["mean"] is None


def greedy(rows, gap, forced=(), count=None, refill=False):
    """One key's (position, score) one by one."""
    picked = [p for p, _ in rows if p in forced]
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    picked.sort(key=[p for p, _ in order].index)
    for p, _ in order:
        if p not in picked and all(abs(p - q) >= gap for q in picked):
            picked.append(p)
    if refill:
        picked += [p for p, _ in order if p not in picked]
    return picked if count is None else picked[:count]


@pytest.mark.parametrize("gap", [1, 4, 30])
def test_spaced_choices_equal_the_greedy_loop(spark, gap):
    rng = random.Random(gap)
    keys = {"a": 150, "b": 12, None: 40, "c": 1}
    own = {k: [(p, rng.randrange(20)) for p in rng.sample(range(-100, 300), n)] for k, n in keys.items()}
    rows = [(k, p, s, "x") for k, v in own.items() for p, s in v]
    df = spark.createDataFrame([*rows, ("a", None, 3, "x"), ("a", 1000, None, "x")], "k string, pos int, score int, other string").repartition(5)
    forced = {k: [p for p, _ in v[:3]] for k, v in own.items() if k != "b"}
    first = spark.createDataFrame([(k, p) for k, v in forced.items() for p in v] + [("a", 5000), ("z", 1)], "k string, pos int")
    for kwargs in ({}, {"forced": first}, {"count": 6}, {"count": 9, "refill": True, "forced": first}):
        found = ordered.spaced(df, ["k"], "pos", "score", gap, **kwargs).collect()
        for k, v in own.items():
            want = greedy(v, gap, forced.get(k, ()) if "forced" in kwargs else (), kwargs.get("count"), kwargs.get("refill", False))
            assert sorted(r.pos for r in found if r.k == k) == sorted(want), (k, kwargs)
    assert ordered.spaced(df.limit(0), ["k"], "pos", "score", gap).count() == 0
    ramp = spark.range(30).select(F.lit("r").alias("k"), "id", F.col("id").alias("s"))
    assert sorted(r.id for r in ordered.spaced(ramp, ["k"], "id", "s", 10).collect()) == [9, 19, 29]


def test_spacing_of_null_and_single_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("a", 9), (None, 2), (None, 8), ("b", 5)], "k string, x int")
    assert {r.k: r.median_gap for r in tables.spacing(df, ["k"], "x").collect()} == {"a": 4.0, None: 6.0, "b": None}
