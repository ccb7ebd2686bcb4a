"""Kernel methods against numpy, and on classes that no line tells apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels, learning


def frame(spark, x, labels=None):
    rows = [(k, [float(v) for v in r], int(labels[k]) if labels is not None else 0) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int")


def test_monomials_give_the_kernel():
    x, y = np.random.default_rng(0).normal(size=(2, 7, 5))
    for kernel in (kernels.Polynomial(1, 0.5), kernels.Polynomial(2, -1.0, 0.3), kernels.Polynomial(3), kernels.Polynomial(4, 0.0, 2.0)):
        mx, my = (kernels._monomials(v, kernel.degree) for v in (x, y))
        assert mx.shape[1] == kernel.monomials(5) and np.allclose(mx * kernel.weights(5) @ my.T, kernel(x, y))


def test_kernel_components_by_monomials_and_by_blocks(spark, monkeypatch):
    """Both ways agree; by monomials, what a round moves has nothing to do with the rows, which are placed where they are."""
    x = np.random.default_rng(4).normal(size=(120, 3)) * [2.0, 1.2, 0.7]
    df = frame(spark, x)
    found = kernels.kernel_components(df, "id", 3)
    monkeypatch.setattr(kernels, "MONOMIALS", 0)
    blocks = kernels.kernel_components(df, "id", 3, block=50)
    assert np.allclose(found.eigenvalues, blocks.eigenvalues)
    for way in (lambda m: m.training(), lambda m: m.project(df, "id")):
        a, b = (np.array([r.features for r in way(m).orderBy("key").collect()]) for m in (found, blocks))
        assert np.allclose(np.abs(a), np.abs(b), atol=1e-4)
    assert "Exchange" not in found.training()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in found.project(df, "id")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("degree", [2, 3])
def test_kernel_components_equal_numpy(spark, degree):
    rng = np.random.default_rng(degree)
    x, y = (rng.normal(size=(n, 4)) * [2.0, 1.2, 0.7, 0.3] for n in (150, 20))
    kernel = kernels.Polynomial(degree)
    model = kernels.kernel_components(frame(spark, x), "id", 3, kernel, block=40)
    own = np.array([r.features for r in model.training().orderBy("key").collect()])
    new = np.array([r.features for r in model.project(frame(spark, y), "id").orderBy("key").collect()])

    k = (x @ x.T / 4 + 1) ** degree
    one = np.full((150, 150), 1 / 150)
    values, axes = np.linalg.eigh(k - one @ k - k @ one + one @ k @ one)
    values, axes = values[::-1][:3], axes[:, ::-1][:, :3]
    assert np.allclose(model.eigenvalues, values)
    sign = np.sign((own * axes).sum(0))
    assert np.allclose(own * sign, axes * np.sqrt(values), atol=1e-4)
    k_new = (y @ x.T / 4 + 1) ** degree
    centred = k_new - k_new.mean(1, keepdims=True) - k.mean(0) + k.mean()
    assert np.allclose(new * sign, centred @ axes / np.sqrt(values), atol=1e-4)


def test_kernel_components_of_few_rows(spark):
    model = kernels.kernel_components(frame(spark, [[1.0, 2.0], [3.0, 1.0], [0.0, 1.0]]), "id", 5)
    assert len(model.eigenvalues) == 2 and model.training().count() == 3
    with pytest.raises(ValueError):
        kernels.kernel_components(frame(spark, [[1.0]]).limit(0), "id", 2)


def test_kernel_machine_tells_rings_apart(spark):
    rng = np.random.default_rng(1)
    angle, label = rng.random(600) * 2 * np.pi, np.arange(600) % 3
    radius = 1.0 + label + rng.normal(size=600) * 0.1
    df = frame(spark, np.c_[radius * np.cos(angle), radius * np.sin(angle)], label)
    train, test = learning.split_by_hash(df, "id", 0.25)
    machine = kernels.kernel_machine(train, "id", kernels.Polynomial(4, 1.0, 0.5), landmarks=100, penalty=1e-4)
    found = machine.predicted(test)
    assert found.columns == ["id", "features", "label", "predicted"] and learning.accuracy(found) > 0.97
    assert {tuple(r.features) for r in found.collect()} == {tuple(r.features) for r in test.collect()}
    assert learning.accuracy(learning.predicted(learning.linear_svm(train, 30), test)) < 0.6
    assert machine.predicted(test.where(F.lit(False))).count() == 0


def test_kernel_machine_maps_a_bounded_number_of_rows_at_once(spark):
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class Strict(kernels.Polynomial):
        def __call__(self, x, y):
            if len(x) > 1024:
                raise ValueError(f"{len(x)} rows at once")
            return (x @ y.T + 1.0) ** 2

    x = np.random.default_rng(3).normal(size=(3000, 2))
    machine = kernels.KernelMachine(Strict(2, 1.0, 1.0), x[:4], np.eye(4)[:, :3])
    found = machine.mapped(frame(spark, x).coalesce(1)).orderBy("id").collect()
    assert np.allclose([r.features for r in found], ((x @ x[:4].T + 1) ** 2)[:, :3])
