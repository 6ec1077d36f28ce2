"""Imputing, scaling, and the classifiers: linear and kernel SVM, MLP, forest, logistic regression."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators.scale import with_row


def impute_mean(train: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values of ``other`` get the train mean."""
    means = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    filled = with_row(other, means).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in cols})
    return filled.drop(*[f"_m_{c}" for c in cols])


def scale_standard(train: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of the train rows; a constant column becomes 0."""
    stats = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_d_{c}") for c in cols])

    def scaled(c: str) -> F.Column:
        dev = F.when(F.col(f"_d_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_d_{c}"))
        return (F.col(c) - F.col(f"_m_{c}")) / dev

    out = with_row(other, stats).withColumns({c: scaled(c) for c in cols})
    return out.drop(*[f"_m_{c}" for c in cols], *[f"_d_{c}" for c in cols])


def with_vector(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    """array column -> vector column, as the learners want it."""
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def svm_linear(c: float, n_rows: int, max_iter: int = 50) -> LinearSVC:
    """A penalty C on the summed loss of n rows is a ridge of 1 / (n C) on the mean loss."""
    return LinearSVC(featuresCol="features", labelCol="label", regParam=1.0 / (n_rows * c), maxIter=max_iter)


def rff(df: DataFrame, gamma: float, dim_in: int, dim_out: int = 128, seed: int = 17, col: str = "features", out: str = "rff") -> DataFrame:
    """Random Fourier features of the rbf kernel exp(-gamma |x - y|^2) (Rahimi & Recht 2007).

    The random directions are ``dim_out`` literal rows; the map itself is a column expression.
    """
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=math.sqrt(2 * gamma), size=(dim_out, dim_in))
    b = rng.uniform(0, 2 * math.pi, size=dim_out)
    x = vector_to_array(F.col(col))
    dirs = F.array(
        *[F.struct(F.array(*[F.lit(float(v)) for v in row]).alias("w"), F.lit(float(o)).alias("b")) for row, o in zip(w, b, strict=True)]
    )

    def feature(d: F.Column) -> F.Column:
        dot = F.aggregate(F.zip_with(d["w"], x, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
        return F.lit(math.sqrt(2.0 / dim_out)) * F.cos(dot + d["b"])

    return df.withColumn(out, array_to_vector(F.transform(dirs, feature)))


def decision_scores(model: Model, df: DataFrame) -> DataFrame:
    """Signed margin and predicted class per row."""
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("rawPrediction")[1])


def cross_validated(
    est: Estimator, grid: list[dict], df: DataFrame, fold: str, folds: int, label: str = "label", metric: str = "accuracy", parallelism: int = 4
) -> CrossValidatorModel:
    """Grid search over the fold column."""
    ev = MulticlassClassificationEvaluator(metricName=metric, labelCol=label)
    cv = CrossValidator(
        estimator=est, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, foldCol=fold, parallelism=parallelism
    )
    return cv.fit(df)


def svm_grid(
    df: DataFrame, dim: int, cs: Iterable[float] = (1, 10, 100, 1000), gammas: Iterable[float] = (0.001, 0.0001),
    fold: str = "fold", folds: int = 3, rff_dim: int = 128, max_iter: int = 20,
) -> DataFrame:
    """(kernel, c, gamma, accuracy), best first. ``df`` has label, features and the fold number.

    The linear kernel has no gamma, so it runs once per C. Rows are kept while the grid runs.
    """
    spark, rows = df.sparkSession, []
    cs = [float(c) for c in cs]
    df = df.persist()
    try:
        n = df.count()
        sets = [("linear", None, df)] + [("rbf", float(g), rff(df, g, dim, rff_dim).drop("features").withColumnRenamed("rff", "features")) for g in gammas]
        for kernel, gamma, data in sets:
            est = LinearSVC(featuresCol="features", labelCol="label", maxIter=max_iter)
            grid = ParamGridBuilder().addGrid(est.regParam, [1.0 / (n * c) for c in cs]).build()
            model = cross_validated(est, grid, data, fold, folds)
            rows += [(kernel, c, gamma, float(a)) for c, a in zip(cs, model.avgMetrics, strict=True)]
    finally:
        df.unpersist()
    out = spark.createDataFrame(rows, "kernel string, c double, gamma double, accuracy double")
    return out.orderBy(F.col("accuracy").desc(), "kernel", "c", "gamma")


def mlp(layers: Sequence[int] = (4096, 1028, 256, 100), max_iter: int = 10, block: int = 128, seed: int = 1234) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label", layers=list(layers), maxIter=max_iter, blockSize=block, seed=seed
    )


def mlp_embedding(model: Model, df: DataFrame, key: str, out: str = "embedding") -> DataFrame:
    """Class probabilities as the embedding of a row."""
    return model.transform(df).select(key, vector_to_array("probability").alias(out))


def random_forest_grid(df: DataFrame, trees: Sequence[int] = (200, 400), fold: str = "fold", folds: int = 10, seed: int = 17) -> CrossValidatorModel:
    est = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed)
    grid = ParamGridBuilder().addGrid(est.numTrees, list(trees)).build()
    return cross_validated(est, grid, df, fold, folds)


def grid_table(df: DataFrame, model: CrossValidatorModel, params: Sequence[tuple]) -> DataFrame:
    """(params..., accuracy) of a fitted grid, best first."""
    rows = [(*p, float(m)) for p, m in zip(params, model.avgMetrics, strict=True)]
    names = [f"p{i}" for i in range(len(params[0]))] + ["accuracy"]
    return df.sparkSession.createDataFrame(rows, names).orderBy(F.col("accuracy").desc(), *names[:-1])


def logistic(max_iter: int = 100) -> LogisticRegression:
    """Unregularised, with intercept."""
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=0.0, fitIntercept=True, maxIter=max_iter)


def logistic_summary(df: DataFrame) -> DataFrame:
    """(term, coefficient, std_error, z, p) of an unregularised binomial fit; the last term is the intercept."""
    fit = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol="label").fit(df)
    s = fit.summary
    coefs = [*fit.coefficients.toArray().tolist(), float(fit.intercept)]
    names = [f"x{i}" for i in range(len(coefs) - 1)] + ["const"]
    rows = zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues, strict=True)
    return df.sparkSession.createDataFrame(
        [(n, *map(float, v)) for n, *v in rows], "term string, coefficient double, std_error double, z double, p double"
    )


def positive_probability(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("probability_1", vector_to_array("probability")[1])
