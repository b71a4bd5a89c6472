import math
import random

import numpy as np
import pytest
from pyspark.mllib.evaluation import BinaryClassificationMetrics, MulticlassMetrics, RankingMetrics, RegressionMetrics
from pyspark.sql import functions as F

from corpuslab.operators import curves, quality, ratings

# Predicted and actual label sets of the multilabel example.
SETS = [([0, 1], [0, 2]), ([0, 2], [0, 1]), ([], [0]), ([2], [2]), ([2, 0], [2, 0]), ([0, 1, 2], [0, 1]), ([1], [1, 2])]


def test_multilabel(spark):
    rows = spark.createDataFrame(SETS, "p array<int>, a array<int>")
    found = quality.multilabel_metrics(rows, "p", "a").first().asDict()
    assert found == pytest.approx(
        {
            "precision": 0.66667, "recall": 0.64286, "f1": 0.63810, "accuracy": 0.54762, "micro_precision": 0.72727,
            "micro_recall": 0.66667, "micro_f1": 0.69565, "hamming_loss": 0.33333, "subset_accuracy": 0.28571,
        },
        abs=1e-5,
    )
    by = {r.label: (r.precision, r.recall, r.f1) for r in quality.multilabel_by_label(rows, "p", "a").collect()}
    assert by[0] == pytest.approx((1.0, 0.8, 0.88889), abs=1e-5)
    assert by[1] == pytest.approx((0.66667, 0.66667, 0.66667), abs=1e-5)
    assert by[2] == pytest.approx((0.5, 0.5, 0.5))


@pytest.mark.parametrize("scores,expected", [([0.9, 0.9, 0.9, 0.1, 0.1, 0.1], 1.0), ([0.9, 0.9, 0.1, 0.1, 0.1, 0.1], 0.83333)])
def test_small_roc_cases(spark, scores, expected):
    rows = spark.createDataFrame(list(zip(scores, [1.0, 1.0, 1.0, 0.0, 0.0, 0.0])), "score double, label double")
    assert curves.areas(curves.threshold_counts(rows, "label", "score")).first().roc_area == pytest.approx(expected, abs=1e-5)


def random_scores(n, classes=1):
    rng = random.Random(9)
    return [(c, round(rng.random(), 2), float(rng.random() < 0.4)) for c in range(classes) for _ in range(n)]


def test_areas_match_the_library(spark):
    rows = spark.createDataFrame(random_scores(500), "c int, score double, label double").repartition(7)
    library = BinaryClassificationMetrics(rows.select("score", "label").rdd.map(tuple))
    found = curves.areas(curves.threshold_counts(rows, "label", "score")).first()
    assert found.roc_area == pytest.approx(library.areaUnderROC)
    assert found.pr_area == pytest.approx(library.areaUnderPR)


def test_macro_roc_against_interpolation(spark):
    data = random_scores(60, 3)
    rows = spark.createDataFrame(data, "c int, score double, label double")
    points = curves.macro_roc(curves.threshold_counts(rows, "label", "score", ["c"]), "c")
    mine = {round(r.fpr, 9): r.tpr for r in points.collect()}
    xs, ys = [], []
    for c in range(3):
        own = sorted(((s, y) for k, s, y in data if k == c), reverse=True)
        p, n = sum(y for _, y in own), sum(1 - y for _, y in own)
        x, y = [0.0], [0.0]
        for t in sorted({s for s, _ in own}, reverse=True):
            y.append(sum(v for s, v in own if s >= t) / p)
            x.append(sum(1 - v for s, v in own if s >= t) / n)
        xs.append(x)
        ys.append(y)
    grid = np.unique(np.concatenate(xs))
    mean = sum(np.interp(grid, x, y) for x, y in zip(xs, ys)) / 3
    assert len(mine) == len(grid)
    for g, m in zip(grid, mean):
        assert mine[round(float(g), 9)] == pytest.approx(m, abs=1e-9)
    area = curves.area_between(points, "fpr", "tpr").first().area
    assert area == pytest.approx(float(((mean[1:] + mean[:-1]) / 2 * np.diff(grid)).sum()))


def test_hard_predictions_fix_log_loss_and_mse(spark):
    rows = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.0), (0, 0.0)], "label int, p double")
    assert curves.log_loss(rows, "label", "p").first().log_loss == pytest.approx(-math.log(1e-14) * 0.25, rel=1e-3)
    assert curves.mean_squared_error(rows, "label", "p").first().mse == 0.25


def test_threshold_is_strict_and_labels_are_checked(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.6)], "label int, p double")
    assert tuple(curves.counts_at(rows, "label", "p", 0.5).first()) == (1, 1, 0, 1, 3)
    with pytest.raises(Exception, match="label must be 0 or 1"):
        curves.counts_at(rows.withColumn("label", F.lit(2)), "label", "p", 0.5).collect()


def test_label_metrics_match_the_library(spark):
    rng = random.Random(2)
    pairs = [(float(rng.randrange(4)), float(rng.randrange(4))) for _ in range(300)] + [(9.0, 0.0)]
    rows = spark.createDataFrame(pairs, "prediction double, label double")
    library = MulticlassMetrics(rows.rdd.map(tuple))
    per_label = quality.label_metrics(quality.confusion(rows))
    found = {r.label: r for r in per_label.collect()}
    for label in range(4):
        r = found[float(label)]
        assert r.precision == pytest.approx(library.precision(float(label)))
        assert r.recall == pytest.approx(library.recall(float(label)))
        assert r.fpr == pytest.approx(library.falsePositiveRate(float(label)))
        assert r.f1 == pytest.approx(library.fMeasure(float(label)))
    assert found[9.0].support == 0 and found[9.0].precision == 0.0
    weighted = quality.weighted_metrics(per_label).first()
    assert weighted.accuracy == pytest.approx(library.accuracy)
    assert weighted.weighted_f1 == pytest.approx(library.weightedFMeasure())
    assert weighted.weighted_fpr == pytest.approx(library.weightedFalsePositiveRate)


def test_ranking_matches_the_library(spark):
    rng = random.Random(4)
    lists = {u: rng.sample(range(30), 10) for u in range(20)}
    wanted = {u: rng.sample(range(30), rng.randrange(1, 12)) for u in range(20)}
    recommended = spark.createDataFrame([(u, i, k + 1) for u, l in lists.items() for k, i in enumerate(l)], "user int, item int, rank int")
    relevant = spark.createDataFrame([(u, i) for u, l in wanted.items() for i in l], "user int, item int")
    library = RankingMetrics(spark.sparkContext.parallelize([(lists[u], wanted[u]) for u in range(20)]))
    found = quality.ranking_metrics(recommended, relevant, "user", "item").first()
    for k in (1, 3, 5):
        assert found[f"precision_at_{k}"] == pytest.approx(library.precisionAt(k))
        assert found[f"ndcg_at_{k}"] == pytest.approx(library.ndcgAt(k))
    assert found["map"] == pytest.approx(library.meanAveragePrecision)


def test_regression_matches_the_library(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(rng.gauss(10, 3), rng.gauss(9, 2)) for _ in range(200)], "prediction double, label double")
    library = RegressionMetrics(rows.rdd.map(tuple))
    found = quality.regression_metrics(rows, "label", "prediction").first()
    assert found.mse == pytest.approx(library.meanSquaredError)
    assert found.mae == pytest.approx(library.meanAbsoluteError)
    assert found.r2 == pytest.approx(library.r2)
    assert found.explained_variance == pytest.approx(library.explainedVariance)


def test_confusion_outputs(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "label string, prediction string")
    counts = quality.confusion(rows)
    wide = {r.label: (r.as_a, r.as_b) for r in quality.confusion_matrix(counts).collect()}
    assert wide == {"a": (1, 1), "b": (0, 2)}
    shares = {(r.label, r.prediction): r.share for r in quality.confusion_shares(counts).collect()}
    assert shares == {("a", "a"): 0.5, ("a", "b"): 0.5, ("b", "b"): 1.0}


def test_ratings(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 2.5), (2, 1, 3.0)], "user int, item int, rating double")
    scaled = {(r.user, r.item): (r.liked, r.clipped) for r in ratings.scaled(rows, -2.5).collect()}
    assert scaled == {(1, 1): (1.0, 1.0), (1, 2): (0.0, 0.0), (2, 1): (1.0, 0.5)}
