"""Tables that several steps of a query read are computed once."""

import pytest
from pyspark.ml.classification import NaiveBayes

from corpuslab.operators import ratings
from corpuslab.plans import load_queries
from corpuslab.plans.registry import QUERIES

load_queries()


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("documents", [(i, f"ALPHA BETA{i % 5} GAMMA{i % 3}", "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    write("orders", [(o, o % 9 + 1) for o in range(40)], "o_orderkey long, o_custkey long")
    write("lineitem", [(o, (o * 7 + k) % 11 + 1, float((o + k) % 5 + 1)) for o in range(40) for k in range(4)], "l_orderkey long, l_partkey long, l_quantity double")
    return str(tmp_path)


def test_naive_bayes_is_fitted_on_written_vectors(spark, tables, monkeypatch):
    files, fit = [], NaiveBayes.fit
    monkeypatch.setattr(NaiveBayes, "fit", lambda self, rows: (files.extend(rows.inputFiles()), fit(self, rows))[1])
    assert QUERIES["ml_naive_bayes"](spark, tables).count() > 0
    assert files and all("train_vectors" in f for f in files)


def test_predictions_read_written_ratings(spark, tables, monkeypatch):
    files, join = [], ratings.predicted_and_actual
    monkeypatch.setattr(ratings, "predicted_and_actual", lambda predicted, actual: (files.extend(actual.inputFiles()), join(predicted, actual))[1])
    found = QUERIES["als_predictions"](spark, tables).collect()
    assert len(found) == 9 and all(r.known for r in found)
    assert files and all("ratings-" in f for f in files)
