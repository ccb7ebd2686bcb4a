"""Sources and sinks on small files, rules that raise, filters and draws against loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import images, lines, runs, signals, spectra, tables
from tessera.sources import files


def one(spark, column, rows=((None,),), names="x string"):
    return [r[0] for r in spark.createDataFrame(list(rows), names).select(column).collect()]


def test_csv_round_trip_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b,c", 2.5)], "id int, name string, v double")
    files.write_csv(df, f"{tmp_path}/t")
    schema = "id int, name string, v double"
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/t", schema).collect())) == [(1, "a", None), (2, "b,c", 2.5)]
    assert files.read_csv(spark, f"{tmp_path}/t", schema, ["v", "missing", "id"]).columns == ["v", "id"]
    assert files.require_columns(df, ["id", "name", "v"]) is df
    with pytest.raises(ValueError):
        files.require_columns(df, ["id", "v"])


def test_listings(spark, tmp_path):
    for name in ("7/a.csv", "12/b.csv", "12/c.csv", "x9/d.csv", "100/e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {(r.label, r.name, r.length) for r in files.listed_files(spark, str(tmp_path), "*.csv").collect()} == {("7", "a.csv", 1), ("12", "b.csv", 1), ("12", "c.csv", 1), ("x9", "d.csv", 1)}
    assert [tuple(r) for r in files.numbered_folders(spark, str(tmp_path)).collect()] == [("7", 1), ("12", 2), ("100", 1)]
    assert [r.id for r in files.numbered_folders(spark, str(tmp_path), most=2).collect()] == ["7", "12"]
    wanted = {"log": ["missing.csv", "7/a.csv", "12/b.csv"], "none": ["q.csv"]}
    assert [(r.artifact, r.path.rsplit("/", 2)[-2:]) for r in files.artifacts(spark, str(tmp_path), wanted).collect()] == [("log", ["7", "a.csv"])]
    assert files.first_existing(spark, [f"{tmp_path}/no", f"{tmp_path}/12", f"{tmp_path}/7"]) == f"{tmp_path}/12"
    assert files.first_existing(spark, [f"{tmp_path}/no"]) is None
    with pytest.raises(FileExistsError):
        files.refuse_existing(spark, f"{tmp_path}/7")
    assert files.refuse_existing(spark, f"{tmp_path}/new") == f"{tmp_path}/new"


def test_json_configurations(spark, tmp_path):
    assert files.read_json_config(spark, f"{tmp_path}/none") == {}
    files.write_json_config(spark, f"{tmp_path}/c", {"r": 4, "name": "é", "deep": {"a": [1]}})
    assert files.read_json_config(spark, f"{tmp_path}/c") == {"r": 4, "name": "é", "deep": {"a": [1]}}
    (tmp_path / "docs").mkdir()
    for k in range(2):
        (tmp_path / "docs" / f"{k}.json").write_text(json.dumps({"k": k, "list": [k]}, indent=1))
    assert sorted(map(tuple, files.read_json_documents(spark, f"{tmp_path}/docs", "k int, list array<int>").collect())) == [(0, [0]), (1, [1])]


def test_snapshot_stream_is_an_upsert(spark, tmp_path):
    from tessera.streaming.snapshots import snapshot_sink

    (tmp_path / "in").mkdir()
    out = f"{tmp_path}/out"
    for rows in ([(1, 1.0), (2, 2.0)], [(2, 5.0), (3, 3.0)]):
        spark.createDataFrame(rows, "step int, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("step int, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = snapshot_sink(stream, out, f"{tmp_path}/state", ["step"])
        query.processAllAvailable()
        query.stop()
    assert sorted((r.step, r.v) for r in spark.read.parquet(out).collect()) == [(1, 1.0), (2, 5.0), (3, 3.0)]


def test_append_stream_writes_rows_once(spark, tmp_path):
    from tessera.streaming.snapshots import append_sink

    (tmp_path / "in").mkdir()
    for rows in ([(1, "a"), (2, "b")], [(3, "c")]):
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = append_sink(spark.readStream.schema("id int, v string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
        query.processAllAvailable()
        query.stop()
    got = files.read_csv(spark, f"{tmp_path}/out", "id int, v string")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_rules_that_raise(spark):
    assert one(spark, values.alias(F.col("x"), {"s": "score"}), [(" S ",)]) == ["score"]
    for column, rows in ((values.alias(F.col("x"), {"s": "score"}), [("t",)]), (tables.strict_int("x"), [(None,)]), (tables.strict_int("x"), [("a",)])):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, column, rows)
    with pytest.raises(ValueError):
        tables.renamed(spark.range(1), ["a", "b"])


def test_low_pass_against_its_difference_equation(spark):
    b, a = spectra.low_pass_coefficients(3, 0.2)
    response = lambda w: abs(np.polyval(b, np.exp(1j * w)) / np.polyval(a, np.exp(1j * w)))
    assert response(0) == pytest.approx(1) and response(0.2 * np.pi) == pytest.approx(2**-0.5) and response(np.pi) < 1e-9
    x, y = np.random.default_rng(3).normal(size=50), np.zeros(50)
    for n in range(50):
        y[n] = sum(b[k] * x[n - k] for k in range(4) if n >= k) - sum(a[k] * y[n - k] for k in range(1, 4) if n >= k)
    assert spectra.filtered(b, a, x, np.zeros(3)) == pytest.approx(y)
    t = np.arange(200) / 100
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 30 * t)
    rows = [((slow + fast).tolist(),), ([2.0] * 30,), ([1.0] * 12,), ([],), (None,)]
    got = one(spark, spectra.low_passed(F.col("x"), 5.0, 100.0), rows, "x array<double>")
    assert np.abs(np.array(got[0]) - slow)[20:-20].max() < 0.03 and got[1] == pytest.approx([2.0] * 30) and got[2:] == [None, None, None]


def test_spectra_of_odd_signals(spark):
    rows = [([],), (None,), ([3.0],), ([1.0, 2.0, 4.0],)]
    m = one(spark, spectra.magnitudes(F.col("x"), 4), rows, "x array<double>")
    assert m[0] == [0.0] * 4 and m[1] is None and m[2] == [3.0, 0, 0, 0] and m[3] == pytest.approx([7, np.abs(np.fft.fft([1, 2, 4]))[1], np.abs(np.fft.fft([1, 2, 4]))[2], 0])
    assert one(spark, spectra.envelope(F.col("x")), rows, "x array<double>")[:2] == [[], None]
    assert one(spark, spectra.spectrogram_db(F.col("x"), 4, 2), rows, "x array<double>")[:2] == [[], None]


def test_alignment_against_a_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for n, m in ((40, 40), (25, 31), (9, 30), (12, 12), (30, 30)):
        p, t = rng.normal(size=n), rng.normal(size=m)
        if n == 30:
            p = np.zeros(30)  # all lags are equal: the smallest wins
        rows.append((p.tolist(), t.tolist()))
        size = min(n, m)
        a, b = p[:size] - p[:size].mean(), t[:size] - t[:size].mean()
        best, lag = -np.inf, 0
        for k in range(-5, 6) if size >= 10 else ():
            pairs = [(a[j], b[j + k]) for j in range(size) if 0 <= j + k < size]
            if len(pairs) >= 10 and sum(x * y for x, y in pairs) > best:
                best, lag = sum(x * y for x, y in pairs), k
        want.append(lag)
    assert one(spark, signals.best_lag(F.col("p"), F.col("t"), 5), rows, "p array<double>, t array<double>") == want


def test_draws_and_splits(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    held = tables.holdout(df, "k", 0.1234)
    assert held.where("held").count() == 124 and held.count() == 1000
    assert tables.holdout(df.limit(3), "k", 0.9, least=200).where("held").count() == 2
    assert tables.holdout(df.limit(0), "k", 0.5).count() == 0
    assert [r.k for r in tables.first_rows(df, ["k"], 337).orderBy("k").collect()] == list(range(337))
    assert tables.first_rows(df, ["k"], 0).count() == 0 and tables.first_rows(df, ["k"], 5000).count() == 1000
    shares = df.select(tables.weighted_choice(tables.uniform(F.col("k"), "s"), [("a", 1), ("b", 3)]).alias("c")).groupBy("c").count().collect()
    assert 650 < {r.c: r["count"] for r in shares}["b"] < 850


def test_spacing_over_partitions(spark):
    rows = [("a", x) for x in (1, 2, 4, 8, 16, 32)] + [("b", 5), (None, 1), (None, 4)]
    got = {r.k: r.median_gap for r in tables.spacing(spark.createDataFrame(rows, "k string, x int").repartition(5), ["k"], "x").collect()}
    assert got == {"a": 4.0, "b": None, None: 3.0}


def test_flat_pictures(spark):
    pixels = [("flat", y, x, 1.0) for y in range(4) for x in range(4)] + [("busy", y, x, (x * y % 3) / 2) for y in range(4) for x in range(4)]
    got = {r["image"]: r["flat"] for r in images.flat(spark.createDataFrame(pixels, "image string, y int, x int, v double")).collect()}
    assert got == {"flat": True, "busy": False}


def test_empty_groups_and_missing_bounds(spark):
    e = spark.createDataFrame([("a", 1), ("a", None)], "f string, correct int")
    got = {r.f: (r.n, r.matches, r.percent) for r in runs.rates(e, ["f"], groups=spark.createDataFrame([("a",), ("b",)], "f string")).collect()}
    assert got == {"a": (2, 1, 50.0), "b": (0, 0, 0.0)}
    none = spark.createDataFrame([("i", 10, 20, 0.0, None, None)], "image string, height int, width int, reference double, low array<struct<x:double,y:double>>, high array<struct<x:double,y:double>>")
    assert lines.family_separation(none).first().sep == -1.0


def test_magnitudes_are_padded_outside_python(spark, monkeypatch):
    signals_ = [[], [1.0, 2.0, -1.0], [3.0], [1.0, 0.0, 2.0, 5.0, 1.0, 1.0], None, [2.0, 2.0, 7.0]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(signals_)], "k int, v array<double>").coalesce(1)
    monkeypatch.setattr(spectra, "SAMPLES", 4)
    found = df.select("k", spectra.magnitudes(F.col("v"), 4).alias("m"))
    assert "array_repeat" in found._jdf.queryExecution().analyzed().toString()
    for r in found.collect():
        v = signals_[r.k]
        if v is None:
            assert r.m is None
        else:
            want = np.abs(np.fft.fft(v))[:4] if v else np.zeros(0)
            assert np.allclose(r.m, np.pad(want, (0, 4 - len(want))))


def test_boundary_grid_finds_all_lines_in_one_pass(spark):
    rows = [("a", 0, 1, 9), ("a", 0, 5, 9), ("a", 90, 2, 8), ("a", 90, 7, 9), ("a", 45, 3, 9), ("a", 0, 2, 1), ("b", 30, 4, 5), ("b", 30, 6, 5)]
    grid = lines.boundary_grid(spark.createDataFrame(rows, "image string, theta int, rho long, votes long"), 0.5, 5.0)
    want = {("a", "D_min", 0, 1, 9), ("a", "D_max", 0, 5, 9), ("a", "P_min", 90, 2, 8), ("a", "P_max", 90, 7, 9), ("b", "D_min", 30, 4, 5), ("b", "D_max", 30, 6, 5)}
    assert set(map(tuple, grid.collect())) == want
    assert grid._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4
