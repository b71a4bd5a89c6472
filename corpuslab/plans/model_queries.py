"""Naive Bayes, neighbours and the evaluation of their predictions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpuslab.operators import bayes, curves, features, learners, neighbors, quality, ratings, terms
from corpuslab.operators.ordering import top_per_group
from corpuslab.plans.registry import query
from corpuslab.plans.tables import BUCKET, DOCS, RATINGS, VEC_BUCKET, corpus, labelled_corpus, rating_rows, table, vectors
from corpuslab.session import materialize

# --- SQL of multinomial naive Bayes over labelled documents d(doc_id, label, tokens).


def nb_sql(labelled: str, smoothing: float, train_percent: int) -> str:
    """CTEs ending in scores(doc_id, label, class, score)."""
    return (
        f"{DOCS}, d AS ({labelled}), train AS (SELECT * FROM d WHERE {BUCKET} < {train_percent}), test AS (SELECT * FROM d WHERE {BUCKET} >= {train_percent}),"
        " classes AS (SELECT label AS class, count(*) AS n_c FROM train GROUP BY label),"
        " ct AS (SELECT label AS class, unnest(tokens) AS term FROM train), cnt AS (SELECT class, term, count(*) AS n FROM ct GROUP BY ALL),"
        " vocab AS (SELECT DISTINCT term FROM ct), v AS (SELECT count(*) AS v FROM vocab), tot AS (SELECT class, sum(n) AS t FROM cnt GROUP BY class),"
        f" prior AS (SELECT class, ln((n_c + {smoothing}::DOUBLE) / ((SELECT count(*) FROM train) + {smoothing}::DOUBLE * (SELECT count(*) FROM classes))) AS p FROM classes),"
        " words AS (SELECT doc_id, unnest(tokens) AS term FROM test), ttf AS (SELECT doc_id, term, count(*) AS tf FROM words JOIN vocab USING (term) GROUP BY ALL),"
        f" parts AS (SELECT ttf.doc_id, c.class, sum(tf * ln((coalesce(cnt.n, 0) + {smoothing}::DOUBLE) / (t + {smoothing}::DOUBLE * v))) AS s"
        " FROM ttf CROSS JOIN classes c JOIN tot ON tot.class = c.class CROSS JOIN v LEFT JOIN cnt ON cnt.class = c.class AND cnt.term = ttf.term GROUP BY ALL),"
        " scores AS (SELECT test.doc_id, test.label, prior.class, p + coalesce(s, 0) AS score FROM test CROSS JOIN prior LEFT JOIN parts ON parts.doc_id = test.doc_id AND parts.class = prior.class)"
    )


LANG_NB = nb_sql("SELECT doc_id, lang AS label, tokens FROM docs", 0.5, 70)
QUALITY_NB = nb_sql("SELECT doc_id, quality AS label, tokens FROM docs JOIN labels USING (doc_id)", 1.0, 80)
PRED = ", pred AS (SELECT doc_id, any_value(label) AS label, arg_max(class, (score, -rk)) AS prediction FROM (SELECT *, dense_rank() OVER (ORDER BY class) AS rk FROM scores) GROUP BY doc_id)"


def lang_scores(spark, folder):
    train, test = features.split_by_hash(corpus(spark, folder, "lang"), "doc_id", 70)
    return bayes.multinomial(train, test, "doc_id", "lang", 0.5)


def quality_scores(spark, folder):
    train, test = features.split_by_hash(labelled_corpus(spark, folder, "quality"), "doc_id", 80)
    return bayes.multinomial(train, test, "doc_id", "quality", 1.0)


def lang_predictions(spark, folder):
    return bayes.best_class(lang_scores(spark, folder), "doc_id", "lang").withColumnRenamed("lang", "label")


def quality_margins(spark, folder):
    """doc_id, label, margin (log odds), prob of the positive class."""
    margin = F.round(F.get("scores", F.lit(1)) - F.get("scores", F.lit(0)), 4).alias("margin")
    rows = bayes.probabilities(quality_scores(spark, folder), "doc_id", "quality", margin)
    return rows.select("doc_id", F.col("quality").alias("label"), "margin", F.get("probs", F.lit(1)).alias("prob"))


@query("nb_multiclass", f"WITH {LANG_NB} SELECT doc_id, label, class, round(score, 4) AS score FROM scores")
def nb_multiclass(spark, folder):
    scored = bayes.class_scores(lang_scores(spark, folder), "doc_id", "lang")
    return scored.select("doc_id", F.col("lang").alias("label"), "class", F.round("score", 4).alias("score"))


@query("nb_binary", f"WITH {QUALITY_NB} SELECT doc_id, label, class, round(score, 4) AS score FROM scores")
def nb_binary(spark, folder):
    scored = bayes.class_scores(quality_scores(spark, folder), "doc_id", "quality")
    return scored.select("doc_id", F.col("quality").alias("label"), "class", F.round("score", 4).alias("score"))


_PROBS = ", top AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM scores), probs AS (SELECT doc_id, label, class, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY doc_id) AS prob FROM top)"


@query("nb_probabilities", f"WITH {LANG_NB}{_PROBS} SELECT doc_id, class, round(prob, 5) AS prob FROM probs")
def nb_probabilities(spark, folder):
    probs = bayes.probabilities(lang_scores(spark, folder), "doc_id", "lang")
    flat = probs.select("doc_id", F.explode(F.arrays_zip("classes", "probs")).alias("p"))
    return flat.select("doc_id", F.col("p.classes").alias("class"), F.round("p.probs", 5).alias("prob"))


@query("nb_predictions", f"WITH {LANG_NB}{PRED} SELECT doc_id, label, prediction FROM pred")
def nb_predictions(spark, folder):
    return lang_predictions(spark, folder)


# One model per class: the rest is the total minus the class.
_OVR = (
    f"{DOCS}, d AS (SELECT doc_id, lang AS label, tokens FROM docs), train AS (SELECT * FROM d WHERE {BUCKET} < 70), test AS (SELECT * FROM d WHERE {BUCKET} >= 70),"
    " classes AS (SELECT DISTINCT label AS class FROM train), tr AS (SELECT c.class, doc_id, label = c.class AS own, tokens FROM train CROSS JOIN classes c),"
    " ct AS (SELECT class, own, unnest(tokens) AS term FROM tr), cnt AS (SELECT class, own, term, count(*) AS n FROM ct GROUP BY ALL),"
    " vocab AS (SELECT DISTINCT term FROM ct), v AS (SELECT count(*) AS v FROM vocab), tot AS (SELECT class, own, sum(n) AS t FROM cnt GROUP BY ALL),"
    " prior AS (SELECT class, own, ln((count(*) + 0.05::DOUBLE) / ((SELECT count(*) FROM train) + 0.1::DOUBLE)) AS p FROM tr GROUP BY ALL),"
    " words AS (SELECT doc_id, unnest(tokens) AS term FROM test), ttf AS (SELECT doc_id, term, count(*) AS tf FROM words JOIN vocab USING (term) GROUP BY ALL),"
    " parts AS (SELECT ttf.doc_id, tot.class, tot.own, sum(tf * ln((coalesce(cnt.n, 0) + 0.05::DOUBLE) / (t + 0.05::DOUBLE * v))) AS s FROM ttf CROSS JOIN tot CROSS JOIN v"
    " LEFT JOIN cnt ON cnt.class = tot.class AND cnt.own = tot.own AND cnt.term = ttf.term GROUP BY ALL),"
    " sides AS (SELECT test.doc_id, prior.class, prior.own, p + coalesce(s, 0) AS side FROM test CROSS JOIN prior LEFT JOIN parts ON parts.doc_id = test.doc_id AND parts.class = prior.class AND parts.own = prior.own)"
)


@query(
    "nb_one_vs_rest",
    f"WITH {_OVR} SELECT doc_id, class, round(sum(CASE WHEN own THEN side ELSE -side END), 3) AS score FROM sides GROUP BY doc_id, class",
)
def nb_one_vs_rest(spark, folder):
    train, test = features.split_by_hash(corpus(spark, folder, "lang"), "doc_id", 70)
    scored = bayes.class_scores(bayes.one_vs_rest(train, test, "doc_id", "lang", 0.05), "doc_id", "lang")
    return scored.select("doc_id", "class", F.round("score", 3).alias("score"))


_BERNOULLI = (
    f"{DOCS}, d AS (SELECT doc_id, lang AS label, list_distinct(tokens) AS tokens FROM docs), train AS (SELECT * FROM d WHERE {BUCKET} < 70), test AS (SELECT * FROM d WHERE {BUCKET} >= 70),"
    " classes AS (SELECT label AS class, count(*) AS n_c FROM train GROUP BY label), ct AS (SELECT label AS class, unnest(tokens) AS term FROM train),"
    " cnt AS (SELECT class, term, count(*) AS n FROM ct GROUP BY ALL), vocab AS (SELECT DISTINCT term FROM ct),"
    " pr AS (SELECT c.class, vocab.term, (coalesce(n, 0) + 0.01::DOUBLE) / (n_c + 0.02::DOUBLE) AS p FROM classes c CROSS JOIN vocab LEFT JOIN cnt ON cnt.class = c.class AND cnt.term = vocab.term),"
    " absent AS (SELECT class, sum(ln(1 - p)) AS a FROM pr GROUP BY class), words AS (SELECT doc_id, unnest(tokens) AS term FROM test),"
    " parts AS (SELECT doc_id, class, sum(ln(p) - ln(1 - p)) AS s FROM words JOIN pr USING (term) GROUP BY ALL),"
    " scores AS (SELECT test.doc_id, c.class, ln((n_c + 0.01::DOUBLE) / ((SELECT count(*) FROM train) + 0.01::DOUBLE * (SELECT count(*) FROM classes))) + a + coalesce(s, 0) AS score"
    " FROM test CROSS JOIN classes c JOIN absent ON absent.class = c.class LEFT JOIN parts ON parts.doc_id = test.doc_id AND parts.class = c.class)"
)


@query("nb_bernoulli", f"WITH {_BERNOULLI} SELECT doc_id, class, round(score, 3) AS score FROM scores")
def nb_bernoulli(spark, folder):
    train, test = features.split_by_hash(corpus(spark, folder, "lang"), "doc_id", 70)
    scored = bayes.class_scores(bayes.bernoulli(train, test, "doc_id", "lang", 0.01), "doc_id", "lang")
    return scored.select("doc_id", "class", F.round("score", 3).alias("score"))


@query(
    "ml_naive_bayes",
    f"WITH {LANG_NB}, idx AS (SELECT class, dense_rank() OVER (ORDER BY class) - 1 AS i FROM classes)"
    " SELECT doc_id, CAST(i AS INT) AS class, round(score, 3) AS score FROM scores JOIN idx USING (class)",
)
def ml_naive_bayes(spark, folder):
    """The library estimator on count vectors gives the same scores as the relational one."""
    rows = features.with_label(corpus(spark, folder, "lang"), "lang")
    train, test = features.split_by_hash(rows, "doc_id", 70)
    index = terms.term_index(terms.document_frequencies(train))
    size = index.count()

    def as_vectors(part):
        triplets = terms.count_triplets(part, index, "doc_id")
        filled = part.select("doc_id", "label").join(features.count_vectors(triplets, size, "doc_id"), "doc_id", "left")
        empty = features.sparse_vector(size, F.array().cast("array<int>"), F.array().cast("array<double>"))
        return filled.withColumn("features", F.coalesce("features", empty))

    model = learners.naive_bayes(0.5).fit(materialize(as_vectors(train), "train_vectors"))  # a fit reads them twice
    scored = model.transform(as_vectors(test)).select("doc_id", F.posexplode(vector_to_array("rawPrediction")).alias("class", "score"))
    return scored.withColumn("score", F.round("score", 3))


# --- Neighbours in the embedding table.
_VEC = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_VTRAIN = f"{_VEC}, tr AS (SELECT * FROM e WHERE {VEC_BUCKET} < 80), te AS (SELECT * FROM e WHERE {VEC_BUCKET} >= 80)"
_CENTROID = (
    f"{_VTRAIN}, cells AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM tr), cen AS (SELECT label AS class, i, avg(x) AS m FROM cells GROUP BY ALL),"
    " tc AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM te),"
    " cs AS (SELECT vec_id, any_value(label) AS label, class, -sum((x - m) * (x - m)) AS score FROM tc JOIN cen USING (i) GROUP BY vec_id, class)"
)


def centroid_scores(spark, folder):
    train, test = features.split_by_hash(vectors(spark, folder), "vec_id", 80)
    return neighbors.nearest_centroid(train, test, "vec_id", "label", "vec")


@query(
    "embedding_neighbors",
    f"WITH {_VEC}, q AS (SELECT v AS qv FROM e WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(v, qv) / sqrt(list_dot_product(v, v) * list_dot_product(qv, qv)), 6) AS score FROM e, q ORDER BY 2 DESC, 1 LIMIT 10",
)
def embedding_neighbors(spark, folder):
    found = neighbors.nearest_to(vectors(spark, folder), "vec_id", "vec", 0, 10)
    return found.withColumn("score", F.round("score", 6))


@query(
    "nearest_centroid",
    f"WITH {_CENTROID} SELECT vec_id, any_value(label) AS label, arg_max(class, score) AS prediction, round(max(score), 5) AS score FROM cs GROUP BY vec_id",
)
def nearest_centroid(spark, folder):
    scored = centroid_scores(spark, folder)
    return bayes.best_class(scored, "vec_id", "label", F.round(F.array_max("scores"), 5).alias("score"))


_KNN = (
    f"{_VTRAIN}, pairs AS (SELECT te.vec_id, tr.vec_id AS near, tr.label, list_dot_product(te.v, te.v) + list_dot_product(tr.v, tr.v) - 2 * list_dot_product(te.v, tr.v) AS d FROM te CROSS JOIN tr),"
    " ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, near) AS rank FROM pairs QUALIFY rank <= 10)"
)


@query("knn_join", f"WITH {_KNN} SELECT vec_id, near, label, CAST(rank AS INT) AS rank, round(d, 5) AS dist2 FROM ranked")
def knn_join(spark, folder):
    train, test = features.split_by_hash(vectors(spark, folder), "vec_id", 80)
    near = neighbors.knn_join(test, train.withColumnRenamed("vec_id", "near"), "vec_id", "near", "vec", 10, "label")
    return near.withColumn("dist2", F.round("dist2", 5))


@query(
    "knn_classify",
    f"WITH {_KNN}, votes AS (SELECT vec_id, label, count(*) AS n FROM ranked GROUP BY ALL) SELECT vec_id, arg_min(label, (-n, label)) AS prediction FROM votes GROUP BY vec_id",
)
def knn_classify(spark, folder):
    train, test = features.split_by_hash(vectors(spark, folder), "vec_id", 80)
    return neighbors.knn_classify(train, test, "vec_id", "label", "vec", 10)


# --- Evaluation.
@query(
    "classifier_report",
    f"WITH {LANG_NB}{PRED} SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS n_right, round(count(*) FILTER (WHERE label = prediction) / count(*)::DOUBLE, 6) AS accuracy FROM pred",
)
def classifier_report(spark, folder):
    right = F.count_if(F.col("label") == F.col("prediction"))
    return lang_predictions(spark, folder).agg(
        F.count("*").alias("n"), right.alias("n_right"), F.round(right / F.count("*").cast("double"), 6).alias("accuracy")
    )


@query(
    "class_keywords",
    f"WITH {DOCS}, ct AS (SELECT lang AS class, unnest(tokens) AS term FROM docs), cnt AS (SELECT class, term, count(*) AS n FROM ct GROUP BY ALL), tot AS (SELECT class, sum(n) AS t FROM cnt GROUP BY class),"
    " v AS (SELECT count(DISTINCT term) AS v FROM ct), w AS (SELECT class, term, round(ln((n + 1.0::DOUBLE) / (t + v)), 6) AS weight FROM cnt JOIN tot USING (class), v)"
    " SELECT class, term, weight, CAST(row_number() OVER (PARTITION BY class ORDER BY weight DESC, term) AS INT) AS rank FROM w QUALIFY rank <= 10",
)
def class_keywords(spark, folder):
    """Heaviest terms per class of a fitted naive Bayes model."""
    rows = corpus(spark, folder, "lang")
    classes = features.classes_of(rows, "lang")
    counts = features.class_term_counts(rows, "lang", classes)
    k = range(len(classes))
    sizes = counts.agg(F.array(*[F.sum(F.get("counts", F.lit(i))) + F.count("*") for i in k]).alias("n")).scalar()
    weights = F.array(
        *[F.struct(F.lit(classes[i]).alias("class"), F.get("counts", F.lit(i)).alias("n"),
                   F.round(F.log((F.get("counts", F.lit(i)) + F.lit(1.0)) / F.get(sizes, F.lit(i))), 6).alias("weight")) for i in k]
    )
    flat = counts.select("term", F.explode(weights).alias("w")).where(F.col("w.n") > 0).select("w.class", "term", "w.weight")
    return top_per_group(flat, "class", 10, F.desc("weight"), F.asc("term"))


@query(
    "error_slices",
    f"WITH {QUALITY_NB}{PRED} SELECT doc_id, CASE WHEN label = 1 AND prediction = 1 THEN 'tp' WHEN label = 0 AND prediction = 0 THEN 'tn' WHEN label = 0 THEN 'fp' ELSE 'fn' END AS kind, lang, source FROM pred JOIN documents USING (doc_id)",
)
def error_slices(spark, folder):
    rows = bayes.best_class(quality_scores(spark, folder), "doc_id", "quality")
    meta = table(spark, folder, "documents").select("doc_id", "lang", "source")
    found = quality.error_kinds(rows, "quality", "prediction").select("doc_id", "kind")
    return found.join(meta, "doc_id")


_MARGIN = (
    f"{QUALITY_NB}, m AS (SELECT doc_id, any_value(label) AS label, round(max(score) FILTER (WHERE class = 1) - max(score) FILTER (WHERE class = 0), 4) AS margin FROM scores GROUP BY doc_id),"
    " top AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS mx FROM scores), pr AS (SELECT doc_id, class, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY doc_id) AS prob FROM top),"
    " s AS (SELECT m.*, prob FROM m JOIN pr USING (doc_id) WHERE pr.class = 1)"
)


@query(
    "binary_counts",
    f"WITH {_MARGIN}, c AS (SELECT count(*) FILTER (WHERE label = 1 AND prob > 0.8) AS tp, count(*) FILTER (WHERE label = 0 AND NOT prob > 0.8) AS tn,"
    " count(*) FILTER (WHERE label = 0 AND prob > 0.8) AS fp, count(*) FILTER (WHERE label = 1 AND NOT prob > 0.8) AS fn, count(*) AS n FROM s)"
    " SELECT *, round((tp + tn) / n::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM c".replace("AS precision", 'AS "precision"'),
)
def binary_counts(spark, folder):
    found = curves.rates(curves.counts_at(quality_margins(spark, folder), "label", "prob", 0.8))
    return found.select("tp", "tn", "fp", "fn", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")])


@query(
    "logloss",
    f"WITH {_MARGIN}, c AS (SELECT label, greatest(least(prob, 1 - 1e-14), 1e-14) AS p FROM s) SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 4) AS log_loss FROM c",
)
def logloss(spark, folder):
    return curves.log_loss(quality_margins(spark, folder), "label", "prob").withColumn("log_loss", F.round("log_loss", 4))


@query(
    "mse_accuracy",
    f"WITH {_MARGIN} SELECT round(avg((label - prob) * (label - prob)), 6) AS mse, round(avg(prob), 6) AS mean_prediction, count(*) FILTER (WHERE label = 1) AS n_positive FROM s",
)
def mse_accuracy(spark, folder):
    rows = quality_margins(spark, folder)
    gap = F.col("label") - F.col("prob")
    return rows.agg(
        F.round(F.avg(gap * gap), 6).alias("mse"),
        F.round(F.avg("prob"), 6).alias("mean_prediction"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
    )


_CURVE = (
    f"{_MARGIN}, pts AS (SELECT margin AS threshold, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY margin),"
    " cv AS (SELECT threshold, pos, neg, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM pts)"
)


def quality_curve(spark, folder):
    return curves.threshold_counts(quality_margins(spark, folder), "label", "margin")


@query(
    "threshold_curve",
    f'WITH {_CURVE}, rates AS (SELECT threshold, tp / (tp + fp)::DOUBLE AS p, tp / np::DOUBLE AS r FROM cv) SELECT threshold, round(p, 6) AS "precision", round(r, 6) AS recall,'
    " round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS f05 FROM rates",
)
def threshold_curve(spark, folder):
    found = curves.threshold_metrics(quality_curve(spark, folder))
    return found.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "f05")])


@query(
    "pr_area",
    f"WITH {_CURVE}, pts2 AS (SELECT threshold, tp / np::DOUBLE AS r, tp / (tp + fp)::DOUBLE AS p FROM cv), st AS (SELECT r - coalesce(lag(r) OVER w, 0) AS dr, (p + coalesce(lag(p) OVER w, p)) / 2 AS h FROM pts2 WINDOW w AS (ORDER BY threshold DESC))"
    " SELECT round(sum(dr * h), 6) AS pr_area FROM st",
)
def pr_area(spark, folder):
    return curves.areas(quality_curve(spark, folder)).select(F.round("pr_area", 6).alias("pr_area"))


@query(
    "roc_area",
    f"WITH {_MARGIN}, pairs AS (SELECT sum(CASE WHEN a.margin > b.margin THEN 1.0 WHEN a.margin = b.margin THEN 0.5 ELSE 0.0 END)::DOUBLE AS won, count(*) AS n FROM s a, s b WHERE a.label = 1 AND b.label = 0)"
    " SELECT round(won / n, 6) AS roc_area FROM pairs",
)
def roc_area(spark, folder):
    return curves.areas(quality_curve(spark, folder)).select(F.round("roc_area", 6).alias("roc_area"))


_OVR_CURVE = (
    f"{_CENTROID}, hits AS (SELECT vec_id, class, CASE WHEN label = class THEN 1 ELSE 0 END AS hit, round(score, 6) AS score FROM cs),"
    " pts AS (SELECT class, score, sum(hit) AS pos, sum(1 - hit) AS neg FROM hits GROUP BY ALL),"
    " cv AS (SELECT class, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER t AS np, sum(neg) OVER t AS nn FROM pts WINDOW w AS (PARTITION BY class ORDER BY score DESC), t AS (PARTITION BY class))"
)


def class_curves(spark, folder):
    rows = curves.one_vs_rest_rows(centroid_scores(spark, folder), "vec_id", "label").withColumn("score", F.round("score", 6))
    return curves.threshold_counts(rows, "hit", "score", ["class"])


@query(
    "roc_points",
    f"WITH {_OVR_CURVE} SELECT class, score AS threshold, round(fp / nn::DOUBLE, 6) AS fpr, round(tp / np::DOUBLE, 6) AS tpr FROM cv",
)
def roc_points(spark, folder):
    found = curves.roc_points(class_curves(spark, folder), ["class"])
    return found.select("class", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "roc_per_class",
    f"WITH {_OVR_CURVE} SELECT class, round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (max(np)::DOUBLE * max(nn)), 6) AS roc_area FROM cv GROUP BY class",
)
def roc_per_class(spark, folder):
    return curves.areas(class_curves(spark, folder), ["class"]).select("class", F.round("roc_area", 6).alias("roc_area"))


@query(
    "roc_micro",
    f"WITH {_OVR_CURVE}, won AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)::DOUBLE AS won, count(*) AS n FROM hits a, hits b WHERE a.hit = 1 AND b.hit = 0)"
    " SELECT round(won / n, 6) AS roc_area FROM won",
)
def roc_micro(spark, folder):
    rows = curves.one_vs_rest_rows(centroid_scores(spark, folder), "vec_id", "label").withColumn("score", F.round("score", 6))
    return curves.areas(curves.threshold_counts(rows, "hit", "score")).select(F.round("roc_area", 6).alias("roc_area"))


# Brute force: every grid point against every class, between its neighbours on the class curve.
_MACRO = (
    f"{_OVR_CURVE}, p AS (SELECT class, fp / nn::DOUBLE AS x, tp / np::DOUBLE AS y FROM cv UNION ALL SELECT DISTINCT class, 0.0::DOUBLE, 0.0::DOUBLE FROM cv),"
    " span AS (SELECT class, x, min(y) AS lo, max(y) AS hi FROM p GROUP BY ALL), seg AS (SELECT class, x, hi, lead(x) OVER w AS x2, lead(lo) OVER w AS lo2 FROM span WINDOW w AS (PARTITION BY class ORDER BY x)),"
    " grid AS (SELECT DISTINCT x AS g FROM span), ys AS (SELECT g, class, arg_max(hi + CASE WHEN x2 IS NULL THEN 0 ELSE (lo2 - hi) * (g - x) / (x2 - x) END, x) AS y FROM grid JOIN seg ON seg.x <= g GROUP BY ALL),"
    " macro AS (SELECT g AS fpr, avg(y) AS tpr FROM ys GROUP BY g)"
)


@query("roc_macro", f"WITH {_MACRO} SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM macro")
def roc_macro(spark, folder):
    points = curves.macro_roc(class_curves(spark, folder), "class")
    return points.select(F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "roc_macro_area",
    f"WITH {_MACRO}, st AS (SELECT (lead(fpr) OVER w - fpr) * (tpr + lead(tpr) OVER w) / 2 AS a FROM macro WINDOW w AS (ORDER BY fpr)) SELECT round(sum(a), 6) AS roc_area FROM st",
)
def roc_macro_area(spark, folder):
    points = curves.macro_roc(class_curves(spark, folder), "class")
    return curves.area_between(points, "fpr", "tpr", "roc_area").withColumn("roc_area", F.round("roc_area", 6))


_CONF = f"{LANG_NB}{PRED}, c AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY ALL)"


@query("confusion", f"WITH {_CONF} SELECT label, prediction, n FROM c")
def confusion(spark, folder):
    return quality.confusion(lang_predictions(spark, folder))


_VCONF = f"WITH {_CENTROID}, pred AS (SELECT vec_id, any_value(label) AS label, arg_max(class, score) AS prediction FROM cs GROUP BY vec_id), c AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY ALL)"


def vector_confusion(spark, folder):
    return quality.confusion(bayes.best_class(centroid_scores(spark, folder), "vec_id", "label"))


@query(
    "confusion_matrix",
    f"WITH {_CONF} SELECT label, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE prediction = '{c}'), 0) AS BIGINT) AS as_{c}" for c in ("de", "en", "es", "fr")) + " FROM c GROUP BY label",
)
def confusion_matrix(spark, folder):
    return quality.confusion_matrix(quality.confusion(lang_predictions(spark, folder)))


@query(
    "confusion_norm",
    f"{_VCONF}, s AS (SELECT *, n / sum(n) OVER (PARTITION BY label)::DOUBLE AS share FROM c), w AS (SELECT *, avg(share) OVER (PARTITION BY prediction) AS m, stddev_samp(share) OVER (PARTITION BY prediction) AS sd FROM s)"
    " SELECT label, prediction, n, round(share, 6) AS share, round(CASE WHEN sd = 0 THEN NULL ELSE (share - m) / sd END, 5) AS z FROM w",
)
def confusion_norm(spark, folder):
    found = quality.confusion_shares(vector_confusion(spark, folder))
    return found.select("label", "prediction", "n", F.round("share", 6).alias("share"), F.round("z", 5).alias("z"))


_LABELS = (
    ", l AS (SELECT label, sum(n) AS support, coalesce(sum(n) FILTER (WHERE label = prediction), 0) AS tp FROM c GROUP BY label), p AS (SELECT prediction AS label, sum(n) AS predicted FROM c GROUP BY prediction),"
    " j AS (SELECT coalesce(l.label, p.label) AS label, CAST(coalesce(support, 0) AS BIGINT) AS support, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(predicted, 0) AS BIGINT) AS predicted, (SELECT sum(n) FROM c) AS t FROM l FULL JOIN p ON l.label = p.label),"
    " r AS (SELECT label, support, tp, predicted - tp AS fp, support - tp AS fn, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted::DOUBLE END AS pr, CASE WHEN support = 0 THEN 0.0 ELSE tp / support::DOUBLE END AS re, (predicted - tp) / (t - support)::DOUBLE AS fpr FROM j),"
    " m AS (SELECT *, CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END AS f1, CASE WHEN pr + re = 0 THEN 0.0 ELSE 1.25 * pr * re / (0.25 * pr + re) END AS f05 FROM r)"
)


@query(
    "label_metrics",
    f'{_VCONF}{_LABELS} SELECT label, support, tp, fp, fn, round(pr, 6) AS "precision", round(re, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1, round(f05, 6) AS f05 FROM m',
)
def label_metrics(spark, folder):
    found = quality.label_metrics(vector_confusion(spark, folder))
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr", "f1", "f05")]
    return found.select("label", "support", "tp", "fp", "fn", *rounded)


@query(
    "weighted_metrics",
    f"{_VCONF}{_LABELS} SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(support * pr) / sum(support)::DOUBLE, 6) AS weighted_precision, round(sum(support * re) / sum(support)::DOUBLE, 6) AS weighted_recall,"
    " round(sum(support * fpr) / sum(support)::DOUBLE, 6) AS weighted_fpr, round(sum(support * f1) / sum(support)::DOUBLE, 6) AS weighted_f1, round(sum(support * f05) / sum(support)::DOUBLE, 6) AS weighted_f05 FROM m",
)
def weighted_metrics(spark, folder):
    found = quality.weighted_metrics(quality.label_metrics(vector_confusion(spark, folder)))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


# Label sets: what a document is labelled with against what simple rules predict.
_SETS = (
    "sets AS (SELECT doc_id, list_filter([CASE WHEN n_chars > 1000 THEN 'good' END, CASE WHEN doc_id % 7 = 0 THEN 'toxic' END, CASE WHEN lang = 'en' THEN 'en' END], lambda x: x IS NOT NULL) AS p,"
    " list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN lang IN ('en', 'fr') THEN lang END], lambda x: x IS NOT NULL) AS a FROM documents JOIN labels USING (doc_id)),"
    " sz AS (SELECT *, len(p)::DOUBLE AS np, len(a)::DOUBLE AS na, len(list_intersect(p, a))::DOUBLE AS b FROM sets)"
)


def label_sets(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(table(spark, folder, "labels"), "doc_id")

    def names(*flags):
        return F.filter(F.array(*flags), lambda x: x.isNotNull())

    return rows.select(
        "doc_id",
        names(F.when(F.col("n_chars") > 1000, "good"), F.when(F.col("doc_id") % 7 == 0, "toxic"), F.when(F.col("lang") == "en", "en")).alias("p"),
        names(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("lang").isin("en", "fr"), F.col("lang"))).alias("a"),
    )


@query(
    "multilabel_metrics",
    f'WITH {_SETS} SELECT round(avg(CASE WHEN np = 0 THEN 0 ELSE b / np END), 6) AS "precision", round(avg(CASE WHEN na = 0 THEN 0 ELSE b / na END), 6) AS recall,'
    " round(avg(CASE WHEN np + na = 0 THEN 0 ELSE 2 * b / (np + na) END), 6) AS f1, round(avg(CASE WHEN np + na - b = 0 THEN 0 ELSE b / (np + na - b) END), 6) AS accuracy,"
    " round(sum(b) / sum(np), 6) AS micro_precision, round(sum(b) / sum(na), 6) AS micro_recall, round(2 * sum(b) / (sum(np) + sum(na)), 6) AS micro_f1,"
    " round(sum(np + na - 2 * b) / (count(*) * (SELECT count(DISTINCT l) FROM (SELECT unnest(a) AS l FROM sets))), 6) AS hamming_loss,"
    " round(avg(CASE WHEN b = np AND b = na THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS subset_accuracy FROM sz",
)
def multilabel_metrics(spark, folder):
    found = quality.multilabel_metrics(label_sets(spark, folder), "p", "a")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(
    "multilabel_by_label",
    f"WITH {_SETS}, pl AS (SELECT doc_id, unnest(p) AS label FROM sets), al AS (SELECT doc_id, unnest(a) AS label FROM sets),"
    " f AS (SELECT coalesce(pl.label, al.label) AS label, count(*) FILTER (WHERE pl.label = al.label) AS tp, count(pl.label) AS np, count(al.label) AS na FROM pl FULL JOIN al ON pl.doc_id = al.doc_id AND pl.label = al.label GROUP BY 1),"
    " r AS (SELECT label, CASE WHEN np = 0 THEN 0.0 ELSE tp / np::DOUBLE END AS pr, CASE WHEN na = 0 THEN 0.0 ELSE tp / na::DOUBLE END AS re FROM f)"
    ' SELECT label, round(pr, 6) AS "precision", round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM r',
)
def multilabel_by_label(spark, folder):
    found = quality.multilabel_by_label(label_sets(spark, folder), "p", "a")
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_SPEND = (
    "spend AS (SELECT CAST(o_custkey AS INT) AS usr, CAST(l_partkey AS INT) AS item, round(max(l_extendedprice), 2) AS spent FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),"
    " rec AS (SELECT usr, item, row_number() OVER (PARTITION BY usr ORDER BY spent DESC, item) AS rank FROM spend QUALIFY rank <= 10)"
)


@query(
    "ranking_metrics",
    f"WITH {RATINGS}, {_SPEND}, rel AS (SELECT usr, item FROM ratings WHERE rating > 30), h AS (SELECT rec.usr, rank, CASE WHEN rel.item IS NULL THEN 0 ELSE 1 END AS hit FROM rec LEFT JOIN rel USING (usr, item)),"
    " c AS (SELECT *, sum(hit) OVER (PARTITION BY usr ORDER BY rank) AS cum FROM h), nr AS (SELECT usr, count(*) AS nr FROM rel GROUP BY usr),"
    " u AS (SELECT usr, any_value(coalesce(nr, 0)) AS nr, sum(hit * cum / rank::DOUBLE) AS prec, "
    + ", ".join(f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) / {k}::DOUBLE AS p{k}, sum(CASE WHEN rank <= {k} THEN hit / ln(rank + 1.0) ELSE 0 END) AS g{k}" for k in (1, 3, 5))
    + " FROM c LEFT JOIN nr USING (usr) GROUP BY usr), i AS (SELECT *, "
    + ", ".join(f"(SELECT sum(1 / ln(x + 1.0)) FROM range(1, least(nr, {k}) + 1) r(x)) AS i{k}" for k in (1, 3, 5))
    + " FROM u) SELECT "
    + ", ".join(f"round(avg(p{k}), 6) AS precision_at_{k}, round(avg(CASE WHEN nr = 0 THEN 0 ELSE g{k} / i{k} END), 6) AS ndcg_at_{k}" for k in (1, 3, 5))
    + ", round(avg(CASE WHEN nr = 0 THEN 0 ELSE prec / nr END), 6) AS map FROM i",
)
def ranking_metrics(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    spend = joined.groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).agg(
        F.round(F.max("l_extendedprice"), 2).alias("rating")
    )
    relevant = ratings.relevant_items(rating_rows(spark, folder), 30.0)
    found = quality.ranking_metrics(ratings.top_items(spend, 10), relevant, "user", "item")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(
    "regression_metrics",
    "WITH r AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem) SELECT round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,"
    " round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(avg((p - (SELECT avg(y) FROM r)) * (p - (SELECT avg(y) FROM r))), 2) AS explained_variance FROM r",
)
def regression_metrics(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))
    digits = {"mse": 2, "rmse": 4, "mae": 4, "r2": 6, "explained_variance": 2}
    found = quality.regression_metrics(rows, "y", "p")
    return found.select(*[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "prediction_report",
    f"{_VCONF}{_LABELS} SELECT metric, CAST(label AS VARCHAR) AS label, round(value, 6) AS value FROM (UNPIVOT (SELECT label, pr AS \"precision\", re AS recall, fpr, f1 FROM m) ON \"precision\", recall, fpr, f1 INTO NAME metric VALUE value)",
)
def prediction_report(spark, folder):
    return quality.metric_rows(quality.label_metrics(vector_confusion(spark, folder))).withColumn("value", F.round("value", 6))
