"""Naive Bayes as two aggregations and one join.

Classes become array positions, so a (document, term) row is joined once and
never multiplied by the number of classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.features import class_term_counts, classes_of
from corpuslab.operators.joins import join_terms
from corpuslab.operators.terms import term_frequencies


def _score_rows(sums: DataFrame, doc: str, label: str, classes: list, bases: list[Column], **scalars: Column) -> DataFrame:
    """``bases`` refer to the columns of ``sums`` and to ``scalars``, subqueries that become columns first.

    ``_priors`` must be among the scalars.
    """
    rows = sums.select("*", *[value.alias(name) for name, value in scalars.items()])
    scores = F.array(*[F.get("_priors", F.lit(i)) + base for i, base in enumerate(bases)])
    return rows.select(doc, label, scores.alias("scores"), F.array(*[F.lit(c) for c in classes]).alias("classes"))


def _total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _weighted_sums(test: DataFrame, weights: DataFrame, doc: str, label: str, k: int, tokens: str) -> DataFrame:
    """doc, label, g0..g(k-1), known: term counts times term weights, and the number of known tokens.

    ``weights`` has term, n (its frequency) and w.
    """
    counted = term_frequencies(test, doc, label, tokens=tokens, keep_empty=True)
    joined = join_terms(counted, weights, doc, "n", "left")
    gains = [F.sum(F.coalesce(F.col("tf") * F.get("w", F.lit(i)), F.lit(0.0))).alias(f"g{i}") for i in range(k)]
    known = F.sum(F.when(F.col("w").isNotNull(), F.col("tf")).otherwise(0)).alias("known")
    return joined.groupBy(doc, label).agg(*gains, known)


def _priors(train: DataFrame, label: str, classes: list, smoothing: float) -> Column:
    k = len(classes)
    return train.agg(
        F.array(
            *[
                F.log((F.count_if(F.col(label) == c) + smoothing) / (F.count(label) + smoothing * k).cast("double"))
                for c in classes
            ]
        ).alias("p")
    ).scalar()


def multinomial(
    train: DataFrame, test: DataFrame, doc: str, label: str, smoothing: float = 1.0, tokens: str = "tokens"
) -> DataFrame:
    """doc, label, scores[], classes[]: log joint score of each class.

    Terms not seen in training are ignored. Document lengths over known terms
    carry the part common to all terms of a class, so unseen (class, term) pairs
    need no rows.
    """
    classes = classes_of(train, label)
    counts = class_term_counts(train.where(F.col(label).isNotNull()), label, classes, tokens)
    sizes = counts.agg(
        F.struct(
            F.count("*").alias("v"), F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(len(classes))]).alias("n")
        ).alias("s")
    ).scalar()
    weights = [F.log(F.get("counts", F.lit(i)) + F.lit(smoothing)) for i in range(len(classes))]
    sums = _weighted_sums(
        test, counts.select("term", _total("counts").alias("n"), F.array(*weights).alias("w")), doc, label, len(classes), tokens
    )
    bases = [
        F.col(f"g{i}") - F.col("known") * F.log(F.get("_sizes.n", F.lit(i)) + F.lit(smoothing) * F.col("_sizes.v"))
        for i in range(len(classes))
    ]
    priors = _priors(train, label, classes, smoothing)
    return _score_rows(sums, doc, label, classes, bases, _priors=priors, _sizes=sizes)


def bernoulli(
    train: DataFrame, test: DataFrame, doc: str, label: str, smoothing: float = 1.0, tokens: str = "tokens"
) -> DataFrame:
    """As ``multinomial``, on presence of terms; absence counts too.

    The absence of every known term is summed once per class; a present term
    then only contributes its difference.
    """
    classes = classes_of(train, label)
    present = train.where(F.col(label).isNotNull()).withColumn("_d", F.array_distinct(tokens))
    counts = class_term_counts(present, label, classes, "_d")
    n_docs = train.agg(F.array(*[F.count_if(F.col(label) == c) for c in classes]).alias("n")).scalar()

    counts = counts.select("term", "counts", n_docs.alias("_docs"))

    def prob(i: int) -> Column:
        return (F.get("counts", F.lit(i)) + F.lit(smoothing)) / (F.get("_docs", F.lit(i)) + 2 * F.lit(smoothing))

    absent = counts.agg(F.array(*[F.sum(F.log(1 - prob(i))) for i in range(len(classes))]).alias("a")).scalar()
    odds = [F.log(prob(i)) - F.log(1 - prob(i)) for i in range(len(classes))]
    weights = counts.select("term", _total("counts").alias("n"), F.array(*odds).alias("w"))
    distinct = test.withColumn("_d", F.array_distinct(tokens))
    sums = _weighted_sums(distinct, weights, doc, label, len(classes), "_d")
    bases = [F.col(f"g{i}") + F.get("_absent", F.lit(i)) for i in range(len(classes))]
    priors = _priors(train, label, classes, smoothing)
    return _score_rows(sums, doc, label, classes, bases, _priors=priors, _absent=absent)


def one_vs_rest(
    train: DataFrame, test: DataFrame, doc: str, label: str, smoothing: float = 1.0, tokens: str = "tokens"
) -> DataFrame:
    """doc, label, scores[], classes[]: log odds of one binary model per class.

    All binary models come out of the same class-by-term counts: the rest of a
    class is the total minus the class.
    """
    classes = classes_of(train, label)
    k = range(len(classes))
    counts = class_term_counts(train.where(F.col(label).isNotNull()), label, classes, tokens).withColumn(
        "all", _total("counts")
    )
    sizes = counts.agg(
        F.struct(
            F.count("*").alias("v"),
            F.sum("all").alias("t"),
            F.array(*[F.sum(F.get("counts", F.lit(i))) for i in k]).alias("n"),
        ).alias("s")
    ).scalar()
    lam = F.lit(smoothing)

    def weight(i: int) -> Column:
        own, everything = F.get("counts", F.lit(i)), F.col("all")
        return F.log(own + lam) - F.log(everything - own + lam)

    weights = counts.select("term", F.col("all").alias("n"), F.array(*[weight(i) for i in k]).alias("w"))
    sums = _weighted_sums(test, weights, doc, label, len(classes), tokens)
    priors = train.agg(
        F.array(
            *[
                F.log(
                    (F.count_if(F.col(label) == c) + smoothing)
                    / (F.count(label) - F.count_if(F.col(label) == c) + smoothing).cast("double")
                )
                for c in classes
            ]
        ).alias("p")
    ).scalar()

    def base(i: int) -> Column:
        own, everything, spread = F.get("_sizes.n", F.lit(i)), F.col("_sizes.t"), lam * F.col("_sizes.v")
        return F.col(f"g{i}") - F.col("known") * (F.log(own + spread) - F.log(everything - own + spread))

    return _score_rows(sums, doc, label, classes, [base(i) for i in k], _priors=priors, _sizes=sizes)


def class_scores(scored: DataFrame, doc: str, label: str) -> DataFrame:
    """doc, label, class, score."""
    pairs = F.arrays_zip("classes", "scores")
    return scored.select(doc, label, F.explode(pairs).alias("p")).select(
        doc, label, F.col("p.classes").alias("class"), F.col("p.scores").alias("score")
    )


def best_class(scored: DataFrame, doc: str, label: str, *keep) -> DataFrame:
    """doc, label, keep, prediction: the class with the largest score, the first one on ties."""
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    return scored.select(doc, label, *keep, F.element_at("classes", best).alias("prediction"))


def probabilities(scored: DataFrame, doc: str, label: str, *keep) -> DataFrame:
    """doc, label, keep, probs[], classes[]: scores turned into class probabilities."""
    shifted = scored.withColumn("_top", F.array_max("scores")).withColumn(
        "_e", F.transform("scores", lambda s: F.exp(s - F.col("_top")))
    )
    summed = shifted.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return summed.select(doc, label, *keep, F.transform("_e", lambda e: e / F.col("_sum")).alias("probs"), "classes")
