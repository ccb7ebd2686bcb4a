"""Every query with a SQL twin gives the twin's rows; operators on small tables with nulls, ties and repeats."""

import glob

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.functions import answers
from tessera.operators import signals, statistics, tables
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    number = lambda x: isinstance(x, (int, float, np.number)) and not isinstance(x, bool)
    clean = lambda x: None if x is None or x is pd.NA or x != x else round(float(x), 5) if number(x) else str(x)
    return sorted((tuple(clean(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(registry.ORACLES[name]).df())


def test_upsert_treats_null_keys_as_equal(spark):
    old = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    new = spark.createDataFrame([(None, 9)], "k string, v int")
    assert sorted(map(tuple, tables.upserted(old, new, ["k"]).collect()), key=str) == sorted([("a", 2), (None, 9)], key=str)


def test_correlation_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "a double, b double")
    assert {(r.a, r.b): r.r for r in statistics.correlation_matrix(df, ["a", "b"]).collect()}[("a", "b")] is None


def test_spaced_peaks_against_a_loop(spark):
    scores = [3, 9, 8, 1, 7, 7, 2, 9]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(scores)], "k string, p int, s int")
    picks = []
    for p in sorted(range(len(scores)), key=lambda i: (-scores[i], i)):
        if all(abs(p - q) >= 3 for q in picks):
            picks.append(p)
    assert signals.spaced_peaks(df, "k", "p", "s", 3).first().picks == picks


def test_streaming_counts_equal_batch(spark, tmp_path):
    from tessera.streaming.snapshots import read_events, windowed_counts

    query = windowed_counts(read_events(spark, SF)).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_snapshot_sink_is_idempotent(spark, tmp_path):
    from tessera.sources.files import write_snapshot

    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", 6.0)], "step int, k string, v double")
    write_snapshot(df, str(tmp_path / "out"), ["step"])
    write_snapshot(df.where("step = 2").withColumn("v", df.v + 1), str(tmp_path / "out"), ["step"])
    assert sorted((r.step, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 5.0), (2, 7.0)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
