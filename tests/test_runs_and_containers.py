"""Run comparisons with nulls and ties; archives, sound and file names, broken ones included."""

import io
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import runs, tables
from tessera.sources import containers


def test_latest_value_prefers_later_rows_and_columns(spark):
    log = spark.createDataFrame(
        [("a", 1, 1, 5.0, None), ("a", 2, 2, 6.0, 7.0), ("a", 2, 3, 8.0, None), ("a", -1, 9, 99.0, 99.0), ("a", 4, 4, None, None), ("b", None, 1, 1.0, 1.0)],
        "run string, step int, o int, loss double, other double",
    )
    assert {r.run: r.value for r in runs.latest_values(log, ["run"], "step", "o", ["loss", "other"]).collect()} == {"a": 8.0, "b": None}
    assert {r.step: r.value for r in runs.values_at_step(log.where("run = 'a'"), ["run"], "step", "o", ["loss", "other"]).collect()} == {1: 5.0, 2: 8.0, 4: None, -1: 99.0}


def test_metric_rows_without_families(spark):
    df = spark.createDataFrame([(1, 0.5, {"x": 0.25}), (2, None, None)], "id int, t double, f map<string,double>")
    assert sorted(map(tuple, runs.metric_rows(df, ["id"], "t", "f").collect()), key=str) == sorted([(1, "all", 0.5), (1, "x", 0.25), (2, "all", None)], key=str)


def test_merge_matches_nulls(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, a int")
    b = spark.createDataFrame([(None, 4), ("x", 5), ("x", 5)], "k string, b int")
    assert sorted(map(tuple, tables.merged(a, b, ["k"]).collect()), key=str) == sorted([(None, 1, 4), ("x", 2, 5), ("x", 2, 5)], key=str)


def test_sized_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(tables.sized(F.col("v"), 2)).collect()] == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for name, text in (("deep/er/log.csv", "c"), ("b/log.csv", "b"), ("a/log.csv", "a"), ("other.txt", "x")):
            z.writestr(name, text)
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    np.savez(tmp_path / "good.npz", masks=np.zeros((2, 3)), H=np.array(2))
    np.savez(tmp_path / "part.npz", H=np.array(2))
    (tmp_path / "bad.npz").write_bytes(b"none")
    (tmp_path / "empty.npz").write_bytes(b"")  # Spark lists no empty files
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([16384, 1, -16384, 1], "<i2").tobytes())
    (tmp_path / "tone.wav").write_bytes(out.getvalue())
    (tmp_path / "noise.wav").write_bytes(b"RIFF")
    for name in ("12/12-0001.png", "12/13-0001.png", "x/x-0001.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"pixels")
    return tmp_path


def test_zip_members(spark, folder):
    members = containers.zip_members(spark, str(folder), contents=True)
    assert members.count() == 5 and members.where("error IS NOT NULL").first().archive.endswith("bad.zip")
    picked = containers.picked_member(members, "log.csv").collect()
    assert [(r.member, bytes(r.content)) for r in picked] == [("a/log.csv", b"a")]


def test_array_archives(spark, folder):
    got = {r.path.split("/")[-1]: r for r in containers.array_archives(spark, str(folder), ["masks"]).collect()}
    assert {k: r.ok for k, r in got.items()} == {"good.npz": True, "part.npz": False, "bad.npz": False}
    wanted = spark.createDataFrame([(k,) for k in (*got, "empty.npz")], "name string")
    assert [r.name for r in runs.missing_names(spark.createDataFrame([(k,) for k in got], "name string"), wanted, "name").collect()] == ["empty.npz"]
    assert got["good.npz"].shapes["masks"] == "2x3" and got["part.npz"].error == "without masks"


def test_sounds(spark, folder):
    got = {r.path.split("/")[-1]: r for r in containers.sounds(spark, str(folder), 3).collect()}
    assert got["tone.wav"].samples == [0.5, -0.5, 0.0] and got["tone.wav"].rate == 8000
    assert got["noise.wav"].samples is None and got["noise.wav"].error


def test_file_names(spark, folder):
    assert [(r.id, r.kind) for r in containers.scan_pairs(spark, str(folder)).collect()] == [("12", "0001")]
    paths = spark.createDataFrame([("out/step-9",), ("out/step-10/",), ("out/step-x",), ("out/other-99",)], "path string")
    assert containers.latest_numbered(paths, "step-").first().path == "out/step-10/"
    assert containers.latest_numbered(paths.where("path = 'out/step-x'"), "step-").count() == 0


def test_resume_points(spark, tmp_path):
    from tessera.sources.files import resume_point

    assert resume_point(spark, str(tmp_path / "none")) is None and resume_point(spark, str(tmp_path)) is None
    for step in (96, 193, 24):
        (tmp_path / f"checkpoint-{step}").mkdir()
    (tmp_path / "checkpoint-999").write_text("a file is no checkpoint")
    path, step = resume_point(spark, str(tmp_path))
    assert step == 193 and path.endswith("checkpoint-193")
    assert resume_point(spark, str(tmp_path), 24)[1] == 24
    with pytest.raises(FileNotFoundError):
        resume_point(spark, str(tmp_path), 25)


def test_broken_files_go_and_are_made_again(spark, tmp_path):
    from tessera.operators.tables import renewed
    from tessera.sources.files import delete_broken

    for name in "abc":
        (tmp_path / name).write_text(name)
    broken = spark.createDataFrame([(str(tmp_path / "a"),), (str(tmp_path / "a"),), (str(tmp_path / "gone"),), (None,)], "path string")
    assert delete_broken(spark, broken) == 1
    left = spark.createDataFrame([(p.name,) for p in tmp_path.iterdir()], "k string")
    assert sorted(r.k for r in renewed(spark.createDataFrame([(k,) for k in "abc"], "k string"), left, "k").collect()) == ["a"]


def test_experiments_are_found_in_folders_and_bundles(spark, tmp_path):
    from tessera.sources.experiments import discovered_experiments

    def bundle(path, members):
        with zipfile.ZipFile(path, "w") as z:
            for name, text in members.items():
                z.writestr(name, text)

    def folder(path, members):
        path.mkdir(parents=True)
        for name, text in members.items():
            (path / name).write_text(text)

    sub = tmp_path / "submissions"
    folder(sub / "first", {"metadata.json": '{"id": "m1", "method": "boxed", "hyperparams": {"r": 4}, "run_config": "none"}', "submission.csv": "id"})
    folder(sub / "second", {"metadata.json": '{"experiment_name": "meta", "run_id": "r7"}', "trainer_log_history.csv": "step"})
    bundle(sub / "second" / "b_diagnostics.zip", {"run_config.json": '{"experiment_name": "diagnostics"}'})
    bundle(sub / "second" / "a_run_bundle.zip", {"deep/er/run_config.json": '{"experiment_name": "deeper"}', "x/run_config.json": '{"experiment_name": "inner"}', "x/probe_evolution.csv": "step"})
    folder(tmp_path / "experiments" / "alpha", {"run_config.json": '{"experiment_name": "A", "prompt_experiment": "short"}'})
    folder(tmp_path / "runs" / "beta", {"trainer_log_history.csv": "step"})
    folder(tmp_path / "elsewhere" / "gamma", {"run_config.json": "{}"})
    (tmp_path / "run_bundles").mkdir()
    bundle(tmp_path / "run_bundles" / "c_run_bundle.zip", {"run_config.json": '{"prompt_experiment": "long"}'})
    (tmp_path / "broken_run_bundle.zip").write_text("no archive")
    bundle(tmp_path / "other.zip", {"run_config.json": "{}"})
    got = {r.place: r for r in discovered_experiments(spark, str(tmp_path)).collect()}
    assert {p: (r.source, r.name, r.method) for p, r in got.items()} == {
        "submissions/first": ("submission archive", "m1", "boxed"),
        "submissions/second": ("submission archive", "inner", "r7"),
        "experiments/alpha": ("run folder", "A", "short"),
        "runs/beta": ("run folder", "beta", None),
        "run_bundles/c_run_bundle.zip": ("run bundle", "c", "long"),
        "broken_run_bundle.zip": ("run bundle", "broken", None),
    }
    assert got["submissions/first"].config == '{"r":4}' and got["runs/beta"].config is None
    assert got["submissions/second"].files == ["a_run_bundle.zip", "b_diagnostics.zip", "metadata.json", "probe_evolution.csv", "run_config.json", "trainer_log_history.csv"]
    assert got["run_bundles/c_run_bundle.zip"].files == ["run_config.json"] and got["broken_run_bundle.zip"].files == []


def test_csv_column_subsets(spark, tmp_path):
    from tessera.sources.files import read_csv

    (tmp_path / "t.csv").write_text("a,b,c\n1,x,2.5\n")
    read = lambda **k: read_csv(spark, str(tmp_path / "t.csv"), "a int, b string, c double", **k)
    assert read(columns=["c", "z", "a"]).columns == ["c", "a"] and read(columns=["b"], strict=True).first().b == "x"
    with pytest.raises(ValueError):
        read(columns=["a", "z"], strict=True)
