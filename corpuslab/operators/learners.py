"""Classifiers and regressors of pyspark.ml with the workload's settings, and tools around fitted models."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import UnivariateFeatureSelector, VectorSlicer
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 11
# Binary models of one-vs-rest fitted at the same time.
PARALLEL_FITS = 4


def naive_bayes(smoothing: float = 1.0, kind: str = "multinomial") -> NaiveBayes:
    return NaiveBayes(smoothing=smoothing, modelType=kind)


def one_vs_rest_bayes(smoothing: float = 0.05) -> OneVsRest:
    return OneVsRest(classifier=NaiveBayes(smoothing=smoothing), parallelism=PARALLEL_FITS)


def decision_tree() -> DecisionTreeClassifier:
    return DecisionTreeClassifier(impurity="gini", maxDepth=4, maxBins=16, seed=SEED)


def random_forest(trees: int = 3) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=trees, featureSubsetStrategy="auto", impurity="gini", maxDepth=4, maxBins=32, seed=SEED
    )


def boosted_trees() -> GBTClassifier:
    return GBTClassifier(maxIter=10, seed=SEED)


def boosted_one_vs_rest() -> OneVsRest:
    """Boosting is binary; one model per class makes it multiclass."""
    return OneVsRest(classifier=GBTClassifier(maxDepth=3, maxIter=20, stepSize=0.2, seed=SEED), parallelism=PARALLEL_FITS)


def logistic(elastic_net: float = 0.0, reg: float = 0.0) -> LogisticRegression:
    return LogisticRegression(fitIntercept=True, elasticNetParam=elastic_net, regParam=reg)


def linear_svc() -> OneVsRest:
    return OneVsRest(classifier=LinearSVC(tol=1e-3), parallelism=PARALLEL_FITS)


def linear_regression() -> LinearRegression:
    return LinearRegression(maxIter=100)


def recommender() -> ALS:
    return ALS(rank=10, maxIter=10, regParam=0.01, userCol="user", itemCol="item", ratingCol="rating", seed=SEED)


def best_features(k: int) -> UnivariateFeatureSelector:
    """The k features with the largest chi-squared score against the label."""
    selector = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="selected", selectionMode="numTopFeatures")
    return selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(k)


class SparseThenSVC:
    """Keep the features an L1-penalised model gives weight to, then fit a linear SVC on them."""

    def __init__(self, reg: float = 0.01):
        self.reg = reg

    def fit(self, train: DataFrame) -> Model:
        chooser = logistic(elastic_net=1.0, reg=self.reg).fit(train)
        used = abs(chooser.coefficientMatrix.toArray()).sum(axis=0).nonzero()[0]
        slicer = VectorSlicer(inputCol="features", outputCol="_kept", indices=[int(i) for i in used] or [0])
        svc = OneVsRest(
            classifier=LinearSVC(featuresCol="_kept", tol=1e-3), featuresCol="_kept", parallelism=PARALLEL_FITS
        )
        return Pipeline(stages=[slicer, svc]).fit(train)


def density(model) -> tuple[int, float]:
    """Coefficients of a linear model, and the share that is not zero."""
    matrix = model.coefficientMatrix.toArray()
    return matrix.size, float((matrix != 0).mean())


def compare(estimators: Mapping[str, Estimator], train: DataFrame, test: DataFrame) -> DataFrame:
    """name, accuracy, train_seconds, test_seconds of each estimator."""
    rows = []
    for name, estimator in estimators.items():
        start = time.perf_counter()
        model = estimator.fit(train)
        fitted = time.perf_counter()
        accuracy = model.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        rows.append((name, accuracy, fitted - start, time.perf_counter() - fitted))
    schema = T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("accuracy", T.DoubleType()),
            T.StructField("train_seconds", T.DoubleType()),
            T.StructField("test_seconds", T.DoubleType()),
        ]
    )
    return train.sparkSession.createDataFrame(rows, schema)
