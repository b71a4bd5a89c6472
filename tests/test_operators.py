import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from corpuslab.operators import bayes, categories, explore, features, joins, learners, lexicon, lsa, neighbors, ordering, terms, topics


def token_rows(spark, *documents):
    return spark.createDataFrame([(i, d.split()) for i, d in enumerate(documents)], "doc_id long, tokens array<string>")


def test_term_frequencies(spark):
    rows = token_rows(spark, "B A B", "", "C")
    found = {(r.doc_id, r.term, r.tf) for r in terms.term_frequencies(rows, "doc_id").collect()}
    assert found == {(0, "A", 1), (0, "B", 2), (2, "C", 1)}
    kept = {(r.doc_id, r.term) for r in terms.term_frequencies(rows, "doc_id", keep_empty=True).collect()}
    assert (1, None) in kept


def test_idf_of_the_three_sentences(spark):
    rows = token_rows(
        spark, "Hi I heard about Spark", "I wish Java could use case classes", "Logistic regression models are neat"
    )
    found = terms.smoothed_idf(terms.document_frequencies(rows), terms.number_of(rows), 2)
    values = {r.term: r.idf for r in found.collect()}
    assert values.pop("I") == pytest.approx(0.28768, abs=1e-5)
    assert set(values.values()) == {0.0}
    hashed = features.hashed_tfidf(rows, min_doc_freq=2).select("doc_id", vector_to_array("features").alias("v"))
    sums = {r.doc_id: r.s for r in hashed.select("doc_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()}
    assert sums == pytest.approx({0: 0.28768, 1: 0.28768, 2: 0.0}, abs=1e-5)


def test_row_index_and_running_totals_span_partitions(spark):
    values = list(range(5000))
    random.Random(3).shuffle(values)
    # One group holds most of the rows.
    rows = spark.createDataFrame([(0 if v % 10 else 1, v, v % 7) for v in values], "g int, v int, w int").repartition(16)
    indexed = ordering.with_row_index(rows, F.asc("v")).collect()
    assert all(r.idx == r.v for r in indexed) and len(indexed) == 5000
    total, expected = {}, {}
    for v in sorted(values, reverse=True):
        g = 0 if v % 10 else 1
        total[g] = total.get(g, 0) + v % 7
        expected[v] = total[g]
    found = ordering.running_totals(rows, [F.desc("v")], {"t": "w"}, ["g"]).collect()
    assert {r.v: r.t for r in found} == expected


def test_join_terms_with_one_dominant_term(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_TERMS", 2)
    rows = spark.createDataFrame(
        [(i, "hot") for i in range(300)] + [(i, f"t{i % 50}") for i in range(300)] + [(7, None), (8, "unknown")],
        "doc_id long, term string",
    )
    table = spark.createDataFrame([("hot", 300, 1.0)] + [(f"t{i}", 6, float(i)) for i in range(50)], "term string, df long, w double")
    inner = joins.join_terms(rows, table, "doc_id", "df")
    plain = rows.join(table, "term")
    assert sorted(map(tuple, inner.select("doc_id", "term", "w").collect())) == sorted(map(tuple, plain.select("doc_id", "term", "w").collect()))
    left = joins.join_terms(rows, table, "doc_id", "df", "left")
    assert left.count() == rows.count()
    assert {r.doc_id for r in left.where("w is null").collect()} == {7, 8}


def test_year_sets(spark):
    base = ["자연", "공학", "정보전자소재융합"]
    years = {2013: base + ["의학"], 2014: base + ["의학", "기초의학", "응용의학", "정보기술융합"]}
    years[2015] = [a for a in years[2014] if a != "의학"] + ["새융합"]
    rows = spark.createDataFrame([(y, a) for y, areas in years.items() for a in areas], "year int, area string")
    found = {(r.year, r.area, r.change) for r in categories.category_changes(rows, "year", "area").collect()}
    assert found == {
        (2014, "기초의학", "added"), (2014, "응용의학", "added"), (2014, "정보기술융합", "added"),
        (2015, "의학", "removed"), (2015, "새융합", "added"),
    }


def test_share_of_an_empty_group_is_null(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0)], "g string, v int")
    assert categories.share(rows, "g", F.col("v") == 1).first().ratio == 0.5


def test_frequency_index_and_one_hot(spark):
    rows = spark.createDataFrame(list(enumerate("abcaac")), "id int, category string")
    encoded = features.frequency_index(rows, "category", "idx", "vec").orderBy("id").collect()
    assert [r.idx for r in encoded] == [0, 2, 1, 0, 0, 1]
    assert [list(r.vec.toArray()) for r in encoded[:3]] == [[1, 0], [0, 0], [0, 1]]
    plain = spark.createDataFrame([(x,) for x in "ABCCD"], "c string")
    vectors = {r.c: list(r.vec) for r in features.one_hot(plain, "c").collect()}
    assert vectors == {"A": [1, 0, 0, 0], "B": [0, 1, 0, 0], "C": [0, 0, 1, 0], "D": [0, 0, 0, 1]}


def test_assembler(spark):
    rows = spark.createDataFrame([(0, 18, 1.0, [0.0, 10.0, 0.5], 1.0)], "id int, hour int, mobile double, u array<double>, clicked double")
    merged = features.assemble(rows.withColumn("user", array_to_vector("u")), ["hour", "mobile", "user"])
    assert list(merged.first().features.toArray()) == [18, 1, 0, 10, 0.5]


def test_lexicon(spark):
    lex = spark.createDataFrame(
        [("나무집", 1, "N", "나무집", ["나무", "집안"]), ("배", 1, "N", "배", []), ("감기", 1, "N", "감기", []), ("감기", 2, "N", "감", []), ("뛰다", 1, "V", "뛰", [])],
        "surface string, rank int, pos string, stem string, parts array<string>",
    )
    rows = token_rows(spark, "나무집 나무집 배 감기 뛰다 없음", "나무집")
    found = {(r.doc_id, r.term, r.tf) for r in lexicon.lexicon_terms(
        terms.term_frequencies(rows, "doc_id"), lex, terms.document_frequencies(rows), "doc_id"
    ).collect()}
    assert found == {(0, "나무", 2), (0, "집안", 2), (0, "감기", 1), (1, "나무", 1), (1, "집안", 1)}


def test_concordance_and_similar_words(spark):
    rows = token_rows(spark, "X A B C A", "X Z B")
    lines = {(r.pos, r.left, r.right) for r in explore.concordance(rows, "doc_id", "A", 2).collect()}
    assert lines == {(1, "X", "B C"), (4, "B C", "")}
    found = explore.similar_words(rows, "A", 5).collect()
    assert [(r.term, r.n_shared) for r in found] == [("Z", 1)]


def test_similar_words_drop_other_contexts_before_the_shuffle(spark):
    texts = [f"A{i} B{i} C{i} D{i}" for i in range(200)] + ["P A Q P Z Q", "P Z Q", "A", "Y"]
    rows = token_rows(spark, *texts)
    found = explore.similar_words(rows, "A", 5)
    assert [(r.term, r.n_shared) for r in found.collect()] == [("Y", 1), ("Z", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan and plan.index("Aggregate [term#") < plan.index("getbit") and "LeftSemi" not in plan
    assert plan.index("getbit") > plan.index("Join Inner, ((left#")  # the root comes first


def test_likely_rows_hold_all_wanted_ones(spark):
    rows = spark.range(5000).select((F.col("id") % 100).alias("x"), F.when(F.col("id") % 7 > 0, F.floor(F.col("id") / 100)).alias("y"))
    wanted = rows.where("x < 3")
    found = joins.likely(rows, wanted, "x", "y")
    assert found.where("x < 3").count() == wanted.count()
    assert found.count() < wanted.count() + 50


def test_top_per_group_limits_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    found = ordering.top_per_group(rows, "g", 3, F.desc("id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {r.id for r in found.collect()} == {994, 995, 996, 997, 998, 999}


def test_knn_join_over_many_tiles(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(90, 4))
    points[5] = points[3]
    rows = spark.createDataFrame([(i, [float(x) for x in p], i % 3) for i, p in enumerate(points)], "id long, vec array<double>, label int")
    queries = rows.where("id < 30").select(F.col("id").alias("q"), "vec")
    found = neighbors.knn_join(queries, rows, "q", "id", "vec", 5, "label", block_rows=16).collect()
    mine = {}
    for r in found:
        mine.setdefault(r.q, {})[r["rank"]] = r.id
    for q in range(30):
        d = ((points - points[q]) ** 2).sum(1)
        assert [mine[q][i] for i in range(1, 6)] == list(np.lexsort((np.arange(90), d))[:5])


def test_presence_test_matches_the_library(spark):
    """Statistics are those of the library bit for bit: repeated and empty documents, a term of all documents, one label."""
    from pyspark.ml.stat import ChiSquareTest

    docs = [(i, float(i % 3), ["all", f"t{i % 5}", f"u{i % 7}", f"u{i % 7}"] + ["rare"] * (i == 4)) for i in range(40)]
    docs += [docs[3], docs[8], (3, 0.0, ["all", "more"]), (None, 1.0, ["all", "t1"]), (None, 1.0, ["all", "t2"]), (50, 2.0, []), (51, 0.0, None)]
    for some in (docs, [(i, 1.0, t) for i, _, t in docs]):
        rows = spark.createDataFrame(some, "doc_id long, label double, tokens array<string>")
        found = {r.term: r.statistic for r in features.presence_test(rows, "doc_id", "label").collect()}
        names = sorted(found)
        index = spark.createDataFrame([(t, k) for k, t in enumerate(names)], "term string, term_id long")
        cells = terms.term_frequencies(rows, "doc_id", "label").drop("tf").distinct().join(index, "term").withColumn("v", F.lit(1.0))
        vectors = features.count_vectors(cells, len(names), "doc_id", "label", value="v")
        wanted = {names[r.featureIndex]: r.statistic for r in ChiSquareTest.test(vectors, "features", "label", flatten=True).collect()}
        assert found == wanted and found["all"] == 0.0


def test_chi2_selection_builds_no_vectors(spark, monkeypatch):
    """The selection counts terms per label; vectors and the library's maps of each term in each task are not needed."""
    from pyspark.ml.stat import ChiSquareTest

    from corpuslab.plans import load_queries
    from corpuslab.plans.registry import QUERIES

    def refuse(*args, **kwargs):
        raise AssertionError("every task would hold a map for each term")

    monkeypatch.setattr(ChiSquareTest, "test", staticmethod(refuse))
    load_queries()
    assert QUERIES["ml_chi2_selection"](spark, "/root/testdata/sf0.001").count() == 50


def test_chi2_by_hand(spark):
    rows = token_rows(spark, "a a b", "b", "a").withColumn("label", F.when(F.col("doc_id") == 1, "y").otherwise("x"))
    found = {r.term: r.chi2 for r in features.chi2(rows, "label").collect()}
    shares = {"x": 2 / 3, "y": 1 / 3}
    for term, counts in {"a": {"x": 3, "y": 0}, "b": {"x": 1, "y": 1}}.items():
        n = sum(counts.values())
        assert found[term] == pytest.approx(sum((counts[c] - shares[c] * n) ** 2 / (shares[c] * n) for c in shares))


def test_too_many_classes_are_refused(spark):
    with pytest.raises(ValueError):
        features.classes_of(spark.range(2000), "id")


# Labelled sentences of the sentiment fixture's shape.
TRAIN = [("good fine great", 1), ("great fine", 1), ("good movie", 1), ("bad awful movie", 0), ("awful poor", 0), ("bad poor", 0)]


def test_naive_bayes_smoke(spark):
    rows = spark.createDataFrame([(i, t.split(), y) for i, (t, y) in enumerate(TRAIN)], "doc_id long, tokens array<string>, label int")
    test = spark.createDataFrame(
        [(10, ["great", "fine", "new"], 1), (11, ["bad", "awful"], 0), (12, [], 0)], "doc_id long, tokens array<string>, label int"
    )
    for method in (bayes.multinomial, bayes.bernoulli, bayes.one_vs_rest):
        scored = method(rows, test, "doc_id", "label", 1.0)
        best = {r.doc_id: r.prediction for r in bayes.best_class(scored, "doc_id", "label").collect()}
        assert best[10] == 1 and best[11] == 0 and 12 in best
    probs = bayes.probabilities(bayes.multinomial(rows, test, "doc_id", "label"), "doc_id", "label")
    assert all(math.isclose(sum(r.probs), 1.0) for r in probs.collect())


def test_singular_values_match_numpy(spark):
    rng = random.Random(5)
    rows = token_rows(spark, *[" ".join(rng.choices("ABCDEFGH", k=12)) for _ in range(40)])
    model = lsa.fit(rows, "doc_id", 8, 8)
    weights = {(r.doc_id, r.term): r.weight for r in terms.tfidf(rows, "doc_id", 8).collect()}
    matrix = np.array([[weights.get((d, t), 0.0) for t in "ABCDEFGH"] for d in range(40)])
    expected = np.linalg.svd(matrix, compute_uv=False)
    assert model.singular == pytest.approx([s for s in expected if s > 1e-7 * expected[0]], rel=1e-6)
    assert np.allclose([r.us for r in model.docs.orderBy("doc_id").collect()], matrix @ np.array([r.v for r in model.terms.orderBy("term").collect()]), atol=1e-8)


def test_concepts_of_few_terms_write_no_other_rows(spark, monkeypatch):
    """With a bounded number of terms the rows of all other terms are neither written nor shuffled."""

    def never(*_, **__):
        raise AssertionError("join_terms")

    monkeypatch.setattr(lsa, "join_terms", never)
    model = lsa.fit(token_rows(spark, "A B C", "A A D", "B D", ""), "doc_id", 2, 2)
    assert sorted(r.term for r in model.terms.collect()) == ["A", "B"]
    assert {r.doc_id: sum(map(abs, r.us)) > 0 for r in model.docs.collect()} == {0: True, 1: True, 2: True, 3: False}


def test_concepts_fit_without_session_settings(spark):
    """The operators need none of ``build_session``'s settings."""
    name = "spark.sql.execution.arrow.pyspark.enabled"
    spark.conf.set(name, "false")
    try:
        model = lsa.fit(token_rows(spark, "A B C", "A A D", "B D"), "doc_id", 4, 2)
        assert len(model.singular) == 2 and model.docs.count() == 3
    finally:
        spark.conf.set(name, "true")


def test_hot_terms_of_the_rows_are_scattered(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "THE").otherwise(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("term"))
    table = rows.where("term <> 'THE'").select("term", F.lit(1).alias("df"))
    seen = rows.groupBy("term").agg(F.count("*").alias("n"))
    found = joins.join_terms(rows, table, "id", "df", "left", seen)
    assert found.count() == 3000 and found.where("df is null").count() == 1000
    plan = found._jdf.queryExecution().toString()
    assert "_key" in plan


def test_long_vectors_keep_their_neighbours(spark):
    rng = np.random.default_rng(4)
    points = 1e4 + rng.normal(size=(400, 64))
    rows = spark.createDataFrame([(i, p.tolist(), i % 3) for i, p in enumerate(points)], "id long, vec array<double>, label int")
    found = neighbors.knn_join(rows.where("id < 20").withColumnRenamed("id", "q"), rows, "q", "id", "vec", 5, "label", block_rows=100)
    by_query = {}
    for r in found.orderBy("q", "rank").collect():
        by_query.setdefault(r.q, []).append(r.id)
    for q, ids in by_query.items():
        assert ids == np.argsort(((points - points[q]) ** 2).sum(1), kind="stable")[:5].tolist()


def test_topic_similarity(spark):
    a = spark.createDataFrame([(0, "x", 1.0), (0, "y", 1.0), (1, "z", 2.0)], "topic int, term string, weight double")
    found = {(r.topic_a, r.topic_b): r.cosine for r in topics.topic_similarity(a, a).collect()}
    assert found == pytest.approx({(0, 0): 1.0, (1, 1): 1.0})


def test_learners_beat_the_majority_class(spark):
    rng = np.random.default_rng(7)
    rows = [(int(y), [float(v) for v in rng.normal(loc=y, size=4)]) for y in rng.integers(0, 3, 240)]
    data = spark.createDataFrame(rows, "y int, v array<double>").select(
        F.col("y").cast("double").alias("label"), array_to_vector("v").alias("features")
    ).cache()
    binary = data.withColumn("label", (F.col("label") > 0).cast("double"))

    def accuracy(estimator, table):
        return estimator.fit(table).transform(table).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]

    def majority(table):
        return table.groupBy("label").count().agg(F.max("count")).first()[0] / table.count()

    for make in (learners.decision_tree, learners.random_forest, learners.boosted_trees, learners.logistic):
        assert accuracy(make(), binary) > majority(binary)
    for make in (learners.random_forest, learners.boosted_one_vs_rest, learners.linear_svc, learners.SparseThenSVC):
        assert accuracy(make(), data) > majority(data)
    size, share = learners.density(learners.logistic().fit(data))
    assert size == 12 and share == 1.0
    table = learners.compare({"tree": learners.decision_tree()}, data, data).first()
    assert table.name == "tree" and table.accuracy > majority(data) and table.train_seconds > 0


def test_rows_of_hot_terms_are_not_shuffled(spark, monkeypatch):
    """Only rows of rare terms meet the table by term; hot rows and rows without a term get no key to be scattered by."""
    monkeypatch.setattr(joins, "HOT_TERMS", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i}") for i in range(400)] + [(9, None)], "doc_id long, term string")
    table = spark.createDataFrame([("hot", 200, 1.0)] + [(f"t{i}", 1, 2.0) for i in range(0, 300, 2)], "term string, df long, w double")
    found = joins.join_terms(rows, table, "doc_id", "df", "left")
    assert "xxhash64" not in found._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.w or 0.0) for r in found.collect()) == sorted([(i, 1.0 if i % 2 else 2.0 if i < 300 else 0.0) for i in range(400)] + [(9, 0.0)])


def test_knn_tiles_hold_a_few_queries_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(90, 5))
    rows = spark.createDataFrame([(i, p.tolist(), i % 3) for i, p in enumerate(points)], "id long, vec array<double>, label int")
    queries = rows.where("id < 40").withColumnRenamed("id", "q")
    whole = sorted(map(tuple, neighbors.knn_join(queries, rows, "q", "id", "vec", 4, "label").collect()))
    monkeypatch.setattr(neighbors, "TILE_QUERIES", 7)
    assert sorted(map(tuple, neighbors.knn_join(queries, rows, "q", "id", "vec", 4, "label").collect())) == whole and len(whole) == 160
