"""Models on feature arrays (key, features array<double>, label): scaling, projections, classifiers and their grids."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.feature import PCA, PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import tables
from tessera.session import durable


def split_by_hash(df: DataFrame, key: str, test: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key: the same rows on every run, without a shuffle."""
    share = F.conv(F.substring(tables.hash_order(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    marked = df.withColumn("_u", share)
    return marked.where(F.col("_u") >= test).drop("_u"), marked.where(F.col("_u") < test).drop("_u")


def standardised(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Features less their mean over their deviation (population) in ``train``; a constant feature keeps scale 1.

    Moments are aggregated by position; the summary has one row, as wide as the feature array.
    """
    cells = train.select(F.posexplode("features").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    summary = cells.agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("_f"))
    scale = lambda x, k: (x - F.get("_f.m", k)) / F.coalesce(F.nullif(F.get("_f.s", k), F.lit(0.0)), F.lit(1.0))
    return [d.join(F.broadcast(summary)).withColumn("features", F.transform("features", scale)).drop("_f") for d in (train, *others)]


def projected(train: DataFrame, parts: int, *others: DataFrame, degree: int = 1) -> tuple[list[DataFrame], list[float]]:
    """Principal components in ``features``, and each one's share of the variance. With a degree above 1, components
    of all monomials up to that degree, which is the polynomial kernel's feature space without its weights."""
    vectors = lambda d: d.withColumn("_v", array_to_vector("features"))
    steps = [PolynomialExpansion(degree=degree, inputCol="_v", outputCol="_e")] if degree > 1 else []
    model = Pipeline(stages=[*steps, PCA(k=parts, inputCol="_e" if steps else "_v", outputCol="_p")]).fit(vectors(train))
    out = [model.transform(vectors(d)).withColumn("features", vector_to_array("_p")).drop("_v", "_e", "_p") for d in (train, *others)]
    return out, [float(x) for x in model.stages[-1].explainedVariance]


def _fitted(train: DataFrame, classifier) -> PipelineModel:
    return Pipeline(stages=[classifier.setFeaturesCol("_v").setLabelCol("label").setPredictionCol("predicted")]).fit(
        train.select(array_to_vector("features").alias("_v"), F.col("label").cast("double").alias("label"))
    )


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``predicted``."""
    done = model.transform(df.withColumn("_v", array_to_vector("features")))
    return done.select(*df.columns, F.col("predicted").cast("int").alias("predicted"))


def logistic(train: DataFrame, rounds: int = 100, penalty: float = 0.0, mix: float = 0.0) -> PipelineModel:
    return _fitted(train, LogisticRegression(maxIter=rounds, regParam=penalty, elasticNetParam=mix))


def linear_svm(train: DataFrame, rounds: int = 50, penalty: float = 0.01) -> PipelineModel:
    """One linear machine for each class against the rest."""
    return _fitted(train, OneVsRest(classifier=LinearSVC(maxIter=rounds, regParam=penalty, featuresCol="_v"), parallelism=2))


def perceptron(train: DataFrame, layers: Sequence[int], rounds: int = 60, seed: int = 42) -> PipelineModel:
    """``layers``: sizes from the number of features to the number of classes."""
    return _fitted(train, MultilayerPerceptronClassifier(layers=list(layers), maxIter=rounds, seed=seed, solver="l-bfgs"))


def accuracy(df: DataFrame) -> float:
    """Share of rows whose prediction is the label; 0 without rows."""
    return df.agg(F.coalesce(F.avg((F.col("predicted") == F.col("label")).cast("double")), F.lit(0.0))).first()[0]


def logistic_grid(train: DataFrame, test: DataFrame, rounds: Sequence[int], penalties: Sequence[float], mixes: Sequence[float]) -> DataFrame:
    """(rounds, penalty, mix, train_accuracy, test_accuracy) of every setting. Settings run one after the other, each
    over the whole training table, which is cut once."""
    train, test = durable(train), durable(test)
    rows = []
    for n, penalty, mix in product(rounds, penalties, mixes):
        model = logistic(train, n, penalty, mix)
        rows.append((n, float(penalty), float(mix), accuracy(predicted(model, train)), accuracy(predicted(model, test))))
    return train.sparkSession.createDataFrame(rows, "rounds int, penalty double, mix double, train_accuracy double, test_accuracy double")
