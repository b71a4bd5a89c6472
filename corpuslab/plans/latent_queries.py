"""Latent semantic analysis and topic models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.functions.arrays import elements
from corpuslab.functions.text import hash_bucket
from corpuslab.operators import categories, features, learners, lsa, ratings, terms, topic_fit, topics
from corpuslab.operators.ordering import top_n
from corpuslab.plans.registry import query
from corpuslab.plans.tables import BUCKET, RATINGS, TF, VEC_BUCKET, cohort, corpus, labelled_corpus, rating_rows, table, vectors
from corpuslab.session import ensure_checkpoints, materialize, new_path
from corpuslab.sources import writers

# At full rank (as many concepts as terms) U·S·Vᵀ is the TF-IDF matrix, so every
# search has an exact counterpart in SQL.
NUM_TERMS = 90
_A = (
    f"WITH {TF}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),"
    f" top AS (SELECT term, ln(CAST(n AS DOUBLE) / df) AS idf FROM df, n ORDER BY df DESC, term LIMIT {NUM_TERMS}), tot AS (SELECT doc_id, sum(tf) AS total FROM tf GROUP BY doc_id),"
    " a AS (SELECT doc_id, term, idf, idf * tf / total AS w FROM tf JOIN top USING (term) JOIN tot USING (doc_id))"
)


_CONCEPTS: dict[tuple[str, str], lsa.Concepts] = {}
_STORED: dict[tuple[str, str], str] = {}


def state_of(spark, folder) -> tuple[str, str]:
    """Stands for this application and the present files of the documents: a model of other files is not taken for theirs."""
    files = table(spark, folder, "documents").select(F.concat_ws("|", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("file"))
    digest = files.distinct().agg(F.md5(F.array_join(F.sort_array(F.collect_list("file")), "|"))).first()[0]
    return spark.sparkContext.applicationId, digest


def full_rank(spark, folder):
    """One model for all searches; its tables lie in the shared folder."""
    key = state_of(spark, folder)
    if key not in _CONCEPTS:
        _CONCEPTS[key] = lsa.fit(corpus(spark, folder), "doc_id", NUM_TERMS, NUM_TERMS)
    return _CONCEPTS[key]


def rounded(found):
    return found.withColumn("score", F.round("score", 6))


@query("lsa_energy", f"{_A} SELECT round(sum(w * w), 6) AS energy FROM a")
def lsa_energy(spark, folder):
    """Squared singular values add up to the squared length of the matrix."""
    values = lsa.singular_values(full_rank(spark, folder), spark)
    return values.agg(F.round(F.sum(F.col("value") * F.col("value")), 6).alias("energy"))


@query(
    "lsa_doc_neighbors",
    f"{_A}, l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM a GROUP BY doc_id HAVING sqrt(sum(w * w)) > 1e-12) SELECT x.doc_id, round(sum(x.w * y.w) / any_value(lx.l * ly.l), 6) AS score FROM a x JOIN a y ON x.term = y.term AND y.doc_id = 1"
    " JOIN l lx ON lx.doc_id = x.doc_id JOIN l ly ON ly.doc_id = 1 GROUP BY x.doc_id ORDER BY 2 DESC, 1 LIMIT 10",
)
def lsa_doc_neighbors(spark, folder):
    return rounded(lsa.documents_like(full_rank(spark, folder), 1, 10))


@query(
    "lsa_term_neighbors",
    f"{_A}, l AS (SELECT term, sqrt(sum(w * w)) AS l FROM a GROUP BY term) SELECT x.term, round(sum(x.w * y.w) / any_value(lx.l * ly.l), 6) AS score FROM a x JOIN a y ON x.doc_id = y.doc_id AND y.term = 'THE'"
    " JOIN l lx ON lx.term = x.term JOIN l ly ON ly.term = 'THE' GROUP BY x.term ORDER BY 2 DESC, 1 LIMIT 10",
)
def lsa_term_neighbors(spark, folder):
    return rounded(lsa.terms_like(full_rank(spark, folder), "THE", 10))


@query("lsa_term_docs", f"{_A} SELECT doc_id, round(w, 6) AS score FROM a WHERE term = 'THE' ORDER BY 2 DESC, 1 LIMIT 10")
def lsa_term_docs(spark, folder):
    return rounded(lsa.documents_for_term(full_rank(spark, folder), "THE", 10))


@query(
    "lsa_query_docs",
    f"{_A} SELECT doc_id, round(sum(w * idf), 6) AS score FROM a WHERE term IN ('THE', 'OF') GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 10",
)
def lsa_query_docs(spark, folder):
    return rounded(lsa.documents_for_terms(full_rank(spark, folder), ["THE", "OF"], 10))


@query(
    "lsa_query_vector",
    f"{_A} SELECT DISTINCT term, CAST((SELECT count(*) FROM top b WHERE b.term < top.term) AS INT) AS term_id, round(idf, 6) AS idf FROM top WHERE term IN ('THE', 'OF', 'NOSUCHWORD')",
)
def lsa_query_vector(spark, folder):
    return lsa.query_vector(full_rank(spark, folder), ["THE", "OF", "NOSUCHWORD"]).withColumn("idf", F.round("idf", 6))


@query(
    "lsa_reconstruction",
    f"{_A} SELECT doc_id, round(sum(w), 6) AS total FROM a GROUP BY doc_id HAVING abs(sum(w)) > 1e-9",
)
def lsa_reconstruction(spark, folder):
    """U·S times Vᵀ summed over terms gives back each document's total weight."""
    model = full_rank(spark, folder)
    k = len(model.singular)
    column_sums = model.terms.agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(k)]).alias("s")).scalar()
    rows = model.docs.select("doc_id", "us", column_sums.alias("s"))
    total = rows.select("doc_id", lsa.dot("us", "s").alias("total")).where(F.abs("total") > 1e-9)
    return total.withColumn("total", F.round("total", 6))


LSA_K = 100


@query(
    "lsa_concepts",
    f"WITH {TF}, size AS (SELECT least({LSA_K}, count(*) FILTER (df < (SELECT count(*) FROM documents))) AS k FROM (SELECT term, count(*) AS df FROM tf GROUP BY term))"
    " SELECT CAST(c AS INT) AS concept, CAST(10 AS BIGINT) AS n_terms, CAST(10 AS BIGINT) AS n_docs, 1.0::DOUBLE AS v_length, 1.0::DOUBLE AS u_length, true AS falling FROM size, range(k) r(c)",
)
def lsa_concepts(spark, folder):
    """Over the whole vocabulary every concept has its ten terms and documents, factors of length 1 and a singular value not above the one before."""
    model = lsa.fit(corpus(spark, folder), "doc_id", None, LSA_K)
    by_term = lsa.concept_terms(model, 10).groupBy("concept").agg(F.count("*").alias("n_terms"))
    by_doc = lsa.concept_documents(model, 10).groupBy("concept").agg(F.count("*").alias("n_docs"))
    squares = lambda rows, v: rows.select(F.posexplode(v).alias("concept", "x")).groupBy("concept").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    values = lsa.singular_values(model, spark)
    before = values.select((F.col("concept") + 1).alias("concept"), F.col("value").alias("before"))
    falling = values.join(before, "concept", "left").withColumn("falling", F.col("before").isNull() | (F.col("value") <= F.col("before")))
    v = squares(model.terms, "v").select("concept", F.round("s", 6).alias("v_length"))
    u = squares(model.docs, "us").withColumnRenamed("s", "us")
    joined = falling.join(by_term, "concept").join(by_doc, "concept").join(v, "concept").join(u, "concept")
    return joined.select("concept", "n_terms", "n_docs", "v_length", F.round(F.col("us") / (F.col("value") * F.col("value")), 6).alias("u_length"), "falling")


# --- Topic models. Weights depend on the random start, shapes do not.
K, ITERATIONS, TERMS_PER_TOPIC = 20, 100, 10


def fitted(spark, folder):
    """One stored model per state of the documents' files and application, shared by all queries about it."""
    key = state_of(spark, folder)
    if key not in _STORED:
        path = new_path(spark, "topics")
        topics.save(topics.fit(corpus(spark, folder), "doc_id", K, ITERATIONS), path)
        _STORED[key] = path
    return topics.load(spark, _STORED[key])


@query("lda_perplexity", f"SELECT CAST(e AS INT) AS exchange, true AS falls, true AS learned FROM range({ITERATIONS // topic_fit.SWEEPS}) r(e)")
def lda_perplexity(spark, folder):
    """Perplexity of all documents over the whole vocabulary falls from exchange to exchange (up to 1 in 100), and by a tenth in all."""
    values = fitted(spark, folder).perplexity
    rows = [(i, v, values[max(0, i - 1)], values[0], values[-1]) for i, v in enumerate(values)]
    found = spark.createDataFrame(rows, "exchange int, value double, before double, first double, last double")
    return found.select("exchange", (F.col("value") <= 1.01 * F.col("before")).alias("falls"), (F.col("last") <= 0.9 * F.col("first")).alias("learned"))


@query(
    "lda_topics",
    f"SELECT CAST(t AS INT) AS topic, CAST({TERMS_PER_TOPIC} AS BIGINT) AS n_terms, true AS in_range FROM range({K}) r(t)",
)
def lda_topics(spark, folder):
    """Every topic has its ten terms, with weights between 0 and 1."""
    found = topics.topic_terms(fitted(spark, folder), TERMS_PER_TOPIC)
    return found.groupBy("topic").agg(F.count("*").alias("n_terms"), F.every(F.col("weight").between(0, 1)).alias("in_range"))


@query(
    "lda_topic_terms",
    f"SELECT CAST(t AS INT) AS topic, CAST({TERMS_PER_TOPIC} AS BIGINT) AS n_terms, CAST(0 AS BIGINT) AS unknown FROM range({K}) r(t)",
)
def lda_topic_terms(spark, folder):
    """The heaviest terms of each topic are different and of the vocabulary."""
    found = topics.topic_terms(fitted(spark, folder), TERMS_PER_TOPIC)
    known = terms.document_frequencies(corpus(spark, folder)).select("term", F.lit(0).alias("known"))
    marked = found.join(known, "term", "left")
    return marked.groupBy("topic").agg(F.count_distinct("term").alias("n_terms"), F.count_if(F.col("known").isNull()).alias("unknown"))


@query(
    "lda_em_topics",
    f"SELECT CAST(t AS INT) AS topic, CAST({TERMS_PER_TOPIC} AS BIGINT) AS n_terms, true AS in_range FROM range(10) r(t)",
)
def lda_em_topics(spark, folder):
    """The settings of the award corpus."""
    model = topics.fit(corpus(spark, folder), "doc_id", 10, 20)
    found = topics.topic_terms(model, TERMS_PER_TOPIC)
    return found.groupBy("topic").agg(F.count("*").alias("n_terms"), F.every(F.col("weight").between(0, 1)).alias("in_range"))


@query(
    "lda_doc_topics",
    f"WITH {TF} SELECT doc_id, CAST({K} AS BIGINT) AS n_topics, 1.0::DOUBLE AS total FROM tf GROUP BY doc_id",
)
def lda_doc_topics(spark, folder):
    """The topic shares of every document add up to 1."""
    weights = topics.topic_weights(fitted(spark, folder))
    return weights.groupBy("doc_id").agg(F.count("*").alias("n_topics"), F.round(F.sum("weight"), 6).alias("total"))


def ranked(rows, by):
    """Per group: how many different members, and whether weights fall with rank."""
    before = F.lag("weight").over(Window.partitionBy(by).orderBy("rank"))
    marked = rows.withColumn("_falls", F.coalesce(F.col("weight") <= before, F.lit(True)))
    return marked.groupBy(by).agg(F.count_distinct("doc_id" if by == "topic" else "topic").alias("n"), F.every("_falls").alias("falling"))


@query("lda_top_docs", f"SELECT CAST(t AS INT) AS topic, CAST(10 AS BIGINT) AS n, true AS falling FROM range({K}) r(t)")
def lda_top_docs(spark, folder):
    """Ten different documents for each topic, weights falling."""
    return ranked(topics.topic_documents(topics.topic_weights(fitted(spark, folder)), "doc_id", 10), "topic")


@query("lda_top_topics", "SELECT doc_id, CAST(3 AS BIGINT) AS n, true AS falling FROM documents")
def lda_top_topics(spark, folder):
    """Three different topics for each document, weights falling."""
    return ranked(topics.document_topics(topics.topic_weights(fitted(spark, folder)), "doc_id", 3), "doc_id")


@query(
    "lda_by_cohort",
    f"SELECT CAST(y AS INT) AS year, CAST(t AS INT) AS topic, CAST({TERMS_PER_TOPIC} AS BIGINT) AS n_terms FROM range({K}) r(t), (SELECT DISTINCT doc_id % 3 + 2013 AS y FROM documents)",
)
def lda_by_cohort(spark, folder):
    """A model of its own for each year."""
    rows = corpus(spark, folder).withColumn("year", cohort())
    found = cohort_topics(rows)
    return found.groupBy("year", "topic").agg(F.count_distinct("term").alias("n_terms"))


def cohort_topics(rows):
    return topics.fit_by(rows, "year", "doc_id", lambda t: topics.topic_terms(t, TERMS_PER_TOPIC), k=K, iterations=ITERATIONS)


@query("lda_overview", f"SELECT CAST(t AS INT) AS topic, CAST({TERMS_PER_TOPIC} AS INT) AS n_terms, true AS heaviest_first FROM range({K}) r(t)")
def lda_overview(spark, folder):
    """One line per topic; its first word is the topic's heaviest."""
    found = topics.topic_terms(fitted(spark, folder), TERMS_PER_TOPIC)
    top = found.groupBy("topic").agg(F.max("weight").alias("most"))
    lines = topics.overview(found).join(top, "topic").withColumn("term", F.substring_index("terms", ",", 1)).join(found, ["topic", "term"])
    return lines.select("topic", F.size(F.split("terms", ",")).alias("n_terms"), (F.col("weight") == F.col("most")).alias("heaviest_first"))


@query(
    "lda_doc_details",
    f"SELECT doc_id, lang, source, string_split(text, chr(10))[1] AS title, CAST({K} AS BIGINT) AS n_topics, CAST({K} AS BIGINT) AS n_lines FROM documents",
)
def lda_doc_details(spark, folder):
    """Every document's title and classification beside its topics and their term lists."""
    found = detail_rows(spark, folder)
    return found.groupBy("doc_id", "lang", "source", "title").agg(F.count("*").alias("n_topics"), F.count_distinct("terms").alias("n_lines"))


def detail_rows(spark, folder):
    model = fitted(spark, folder)
    lines = topics.overview(topics.topic_terms(model, TERMS_PER_TOPIC))
    best = topics.document_topics(topics.topic_weights(model), "doc_id", 20)
    meta = table(spark, folder, "documents").select("doc_id", "lang", "source", F.substring_index("text", "\n", 1).alias("title"))
    return topics.document_details(best, lines, meta, "doc_id")


def meta_rows(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "source").join(table(spark, folder, "labels"), "doc_id")


@query("topic_composition")
def topic_composition(spark, folder):
    best = topics.topic_documents(topics.topic_weights(fitted(spark, folder)), "doc_id", 100)
    counts = topics.topic_composition(best, meta_rows(spark, folder), "doc_id", ["lang", "source", "quality"])
    return categories.composition_text(counts, "topic")


@query("topic_class_share")
def topic_class_share(spark, folder):
    best = topics.topic_documents(topics.topic_weights(fitted(spark, folder)), "doc_id", 100)
    return topics.topic_share(best, meta_rows(spark, folder), "doc_id", F.col("quality") == 1)


@query("topic_json")
def topic_json(spark, folder):
    return writers.topic_json(topics.topic_terms(fitted(spark, folder), TERMS_PER_TOPIC))


@query("topics_used_hist", f"WITH {TF} SELECT count(DISTINCT doc_id) AS n_docs FROM tf")
def topics_used_hist(spark, folder):
    """The histogram of topics used covers every document once."""
    found = topics.topics_used(topics.topic_weights(fitted(spark, folder)), "doc_id", 0.1)
    return found.agg(F.sum("n_docs").alias("n_docs"))


# Language-by-cohort term shares serve as topics with known weights.
_CLASS_TOPICS = (
    f"WITH {TF}, ct AS (SELECT CAST(tf.doc_id % 3 AS INT) AS part, tf.lang, term, sum(tf)::DOUBLE AS w FROM tf GROUP BY ALL)"
)


@query(
    "topic_similarity",
    f"{_CLASS_TOPICS}, a AS (SELECT lang AS topic, term, w FROM ct WHERE part = 0), b AS (SELECT lang AS topic, term, w FROM ct WHERE part = 1),"
    " la AS (SELECT topic, sqrt(sum(w * w)) AS l FROM a GROUP BY topic), lb AS (SELECT topic, sqrt(sum(w * w)) AS l FROM b GROUP BY topic)"
    " SELECT a.topic AS topic_a, b.topic AS topic_b, round(sum(a.w * b.w) / any_value(la.l * lb.l), 6) AS cosine FROM a JOIN b ON a.term = b.term JOIN la ON la.topic = a.topic JOIN lb ON lb.topic = b.topic GROUP BY 1, 2",
)
def topic_similarity(spark, folder):
    rows = corpus(spark, folder, "lang").select((F.col("doc_id") % 3).alias("part"), F.col("lang").alias("topic"), F.explode(elements("tokens")).alias("term"))
    shares = rows.groupBy("part", "topic", "term").agg(F.count("*").cast("double").alias("weight"))
    a, b = shares.where("part = 0").drop("part"), shares.where("part = 1").drop("part")
    return topics.topic_similarity(a, b).withColumn("cosine", F.round("cosine", 6))


# --- Learners on the embedding table, split by id hash.
def vector_split(spark, folder, label=None):
    value = F.col("label").cast("double") if label is None else label
    rows = vectors(spark, folder).select("vec_id", value.alias("label"), array_to_vector("vec").alias("features"))
    return features.split_by_hash(rows, "vec_id", 80)


def even_label():
    return (F.col("label") % 2).cast("double")


def judged(model, train, test):
    """Per label: test rows, whether all predictions are labels, and whether the model fits its training rows at least
    as well as the commonest label does. The labels of this table do not depend on the vectors, so test accuracy says nothing.
    """
    predicted = model.transform(test)
    limits = train.agg(F.struct(F.min("label").alias("least"), F.max("label").alias("most")).alias("l")).scalar()
    fitted_ = model.transform(train).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("right"))
    useful = fitted_.agg((F.sum("right") >= F.max("n")).alias("u")).scalar()
    counts = predicted.groupBy("label").agg(F.count("*").alias("n"), F.min("prediction").alias("_low"), F.max("prediction").alias("_high"))
    marked = counts.withColumn("_l", limits).withColumn("useful", useful)
    return marked.select("label", "n", ((F.col("_low") >= F.col("_l.least")) & (F.col("_high") <= F.col("_l.most"))).alias("known"), "useful")


def vector_labels(label, test=f"{VEC_BUCKET} >= 80"):
    return f"SELECT CAST({label} AS DOUBLE) AS label, count(*) AS n, true AS known, true AS useful FROM embeddings WHERE {test} GROUP BY 1"


def learner_query(name, make, label="label", value=None):
    """One learner on the embedding table, judged on its test rows."""

    @query(name, vector_labels(label))
    def run(spark, folder):
        train, test = vector_split(spark, folder, None if value is None else value())
        return judged(make().fit(train), train, test)


learner_query("ml_tree", learners.decision_tree, "label % 2", even_label)
learner_query("ml_forest_binary", learners.random_forest, "label % 2", even_label)
learner_query("ml_forest", learners.random_forest)
learner_query("ml_gbt", learners.boosted_trees, "label % 2", even_label)
learner_query("ml_gbt_ovr", learners.boosted_one_vs_rest, "label % 3", lambda: (F.col("label") % 3).cast("double"))
learner_query("ml_logreg", learners.logistic)
learner_query("ml_elastic_net", lambda: learners.logistic(elastic_net=0.5, reg=0.001))
learner_query("ml_svc", learners.linear_svc)
learner_query("ml_l1_svc", lambda: learners.SparseThenSVC(0.001))


# --- Learners on the hashed TF-IDF of documents, trained, tested and scored on 70, 25 and 5 percent by id hash.
DOC_FEATURES = 1 << 20
LINEAR_FEATURES = 1 << 16  # a linear model's solver keeps several dense vectors per class
_LANGS = "(SELECT *, dense_rank() OVER (ORDER BY lang) - 1 AS label FROM documents WHERE lang IS NOT NULL)"
_ENGLISH = "(SELECT doc_id, CAST(lang = 'en' AS INT) AS label FROM documents WHERE lang IS NOT NULL)"
_QUALITY = "(SELECT doc_id, quality AS label FROM documents JOIN labels USING (doc_id))"
# Languages show in the text, so a model must reach the share of the commonest; quality hardly does.
_LABELS = {"lang": (_LANGS, 1.0), "english": (_ENGLISH, 1.0), "quality": (_QUALITY, 0.9)}


def document_parts(spark, folder, label, num_features):
    if label == "quality":
        rows = labelled_corpus(spark, folder, "quality").withColumn("label", F.col("quality").cast("double"))
    elif label == "english":
        rows = corpus(spark, folder, "lang").where("lang is not null").withColumn("label", (F.col("lang") == "en").cast("double"))
    else:
        rows = features.with_label(corpus(spark, folder, "lang"), "lang")
    weighted = features.hashed_tfidf(rows, num_features).select("doc_id", "label", "features")
    bucket = hash_bucket("doc_id")
    weighted = materialize(weighted.withColumn("part", F.when(bucket < 70, "train").when(bucket < 95, "test").otherwise("eval")), "hashed")
    return weighted.where("part = 'train'"), weighted.where("part <> 'train'")


def document_query(name, make, label, num_features=DOC_FEATURES):
    labels_, least = _LABELS[label]
    part = f"CASE WHEN {BUCKET} < 95 THEN 'test' ELSE 'eval' END"

    @query(name, f"SELECT {part} AS part, CAST(label AS DOUBLE) AS label, count(*) AS n, true AS useful FROM {labels_} WHERE {BUCKET} >= 70 GROUP BY 1, 2")
    def run(spark, folder):
        train, rest = document_parts(spark, folder, label, num_features)
        predicted = make().fit(train).transform(rest).select("part", "label", "prediction")
        counts = predicted.groupBy("part", "label").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("right"))
        every = Window.partitionBy(F.lit(0))  # one row per part and label
        marked = counts.withColumn("_all", F.sum("n").over(Window.partitionBy("label"))).withColumn("_right", F.sum("right").over(every))
        return marked.select("part", "label", "n", (F.col("_right") >= least * F.max("_all").over(every)).alias("useful"))


document_query("doc_bayes_binary", lambda: learners.naive_bayes(1.0), "quality")
document_query("doc_bayes", lambda: learners.naive_bayes(0.5), "lang")
document_query("ml_ovr", learners.one_vs_rest_bayes, "lang")
document_query("doc_logreg", lambda: learners.logistic(reg=0.01), "lang", LINEAR_FEATURES)
document_query("doc_svc", learners.linear_svc, "lang", LINEAR_FEATURES)


@query("ml_chi2_selection")
def ml_chi2_selection(spark, folder):
    """The 50 best of the chi-squared test on presence of terms; a feature is a term's number in the whole vocabulary.

    Ranked by the statistic: p-values of a large vocabulary round to 0 for more than 50 terms.
    """
    tested = features.presence_test(features.with_label(corpus(spark, folder, "lang"), "lang"), "doc_id", "label")
    best = top_n(terms.term_index(tested), 50, F.desc("statistic"), F.asc("term_id"))
    return best.select(F.col("term_id").cast("int").alias("feature"))


@query("ml_compare", "SELECT unnest(['decision_tree', 'random_forest', 'logistic', 'linear_svc']) AS name, true AS scored, true AS timed")
def ml_compare(spark, folder):
    """Accuracy and times of each classifier."""
    train, test = (materialize(part, "compared") for part in vector_split(spark, folder))
    estimators = {
        "decision_tree": learners.decision_tree(),
        "random_forest": learners.random_forest(100),
        "logistic": learners.logistic(),
        "linear_svc": learners.linear_svc(),
    }
    found = learners.compare(estimators, train, test)
    return found.select("name", F.col("accuracy").between(0, 1).alias("scored"), ((F.col("train_seconds") > 0) & (F.col("test_seconds") > 0)).alias("timed"))


@query(
    "linreg_closed_form",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem",
)
def linreg_closed_form(spark, folder):
    """The fitted line of the library against the closed form."""
    rows = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("label"), "l_quantity")
    model = learners.linear_regression().fit(features.assemble(rows, ["l_quantity"]))
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 2), round(float(model.intercept), 1))], "slope double, intercept double"
    )


@query("als_recs", f"WITH {RATINGS} SELECT usr AS user, CAST(10 AS BIGINT) AS n_items, true AS falling FROM ratings GROUP BY usr")
def als_recs(spark, folder):
    """Ten different items for each user, expected ratings falling."""
    ensure_checkpoints(spark)
    model = learners.recommender().fit(rating_rows(spark, folder))
    found = ratings.recommendations(model, 10)
    before = F.lag("score").over(Window.partitionBy("user").orderBy("rank"))
    marked = found.withColumn("_falls", F.coalesce(F.col("score") <= before, F.lit(True)))
    return marked.groupBy("user").agg(F.count_distinct("item").alias("n_items"), F.every("_falls").alias("falling"))


@query("als_predictions", f"WITH {RATINGS} SELECT usr AS user, count(*) AS n, true AS known, true AS useful FROM ratings GROUP BY usr")
def als_predictions(spark, folder):
    """Every rating gets a prediction; together they are nearer than the mean rating."""
    ensure_checkpoints(spark)
    rows = materialize(rating_rows(spark, folder), "ratings")  # the fit, the predictions and the join read it
    predicted = learners.recommender().fit(rows).transform(rows).select("user", "item", "prediction")
    both = materialize(ratings.predicted_and_actual(predicted, rows), "predicted")
    gap = F.col("prediction") - F.col("rating")
    useful = both.agg((F.avg(gap * gap) < F.var_pop("rating")).alias("u")).scalar()
    counted = both.groupBy("user").agg(F.count("*").alias("n"), F.every(F.col("prediction").isNotNull()).alias("known"))
    return counted.withColumn("useful", useful)
