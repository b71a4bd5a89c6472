"""Topic models: fit, store, describe, relate to documents and classifications."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import topic_fit
from corpuslab.operators.categories import composition, share
from corpuslab.operators.features import classes_of
from corpuslab.operators.ordering import top_per_group
from corpuslab.operators.terms import count_triplets, document_frequencies, term_index, top_terms
from corpuslab.session import materialize, remove, scratch, written

# Cohorts fitted at the same time.
PARALLEL_FITS = 3


@dataclass
class Topics:
    """A fitted model.

    terms: term, df, term_id, weights (share of each topic's words that are this term); documents: doc, weights (topic
    shares); perplexity before each exchange of the fit.
    """

    doc: str
    k: int
    terms: DataFrame
    documents: DataFrame
    perplexity: list[float]


def fit(
    corpus: DataFrame,
    doc: str,
    k: int,
    iterations: int,
    seed: int = 7,
    tokens: str = "tokens",
    num_terms: int | None = None,
    alpha: float | None = None,
    beta: float = 0.1,
) -> Topics:
    """Fit on all terms, or on the ``num_terms`` of most documents.

    Terms, counts and shares are tables; the driver sees ``k`` totals. Documents without any of the terms, with none at
    all too, get equal shares of all topics. ``alpha`` (50 / k unless told otherwise) and ``beta`` are the priors.
    """
    alpha = 50.0 / k if alpha is None else alpha
    with scratch(corpus.sparkSession):  # only the two tables of the model stay
        frequencies = document_frequencies(corpus, tokens)
        if num_terms is not None:
            frequencies = top_terms(frequencies, num_terms)
        terms = materialize(term_index(frequencies), "terms")
        size = terms.count()
        with scratch(corpus.sparkSession):
            cells, cells_path = written(count_triplets(corpus, terms, doc, tokens), "counts")
        shares, counts, totals, perplexity = topic_fit.fit(cells, doc, k, iterations, size, alpha, beta, seed)
        remove(corpus.sparkSession, cells_path)
        weights = F.array(*[(F.get("w", F.lit(i)) + beta) / (float(totals[i]) + size * beta) for i in range(k)])
        described = terms.join(counts, "term_id").select("term", "df", "term_id", weights.alias("weights"))
        every = corpus.select(doc).distinct().join(shares, doc, "left")
        every = every.withColumn("weights", F.coalesce("weights", F.array(*[F.lit(1.0 / k)] * k)))
        described, every = written(described, "described_terms")[0], written(every, "described_documents")[0]
    return Topics(doc, k, described, every, perplexity)


def save(topics: Topics, path: str) -> None:
    """Two tables and their description. The description comes last, so a half-written model is no model."""
    topics.terms.write.parquet(f"{path}/terms")
    topics.documents.write.parquet(f"{path}/documents")
    line = json.dumps({"doc": topics.doc, "k": topics.k, "perplexity": topics.perplexity})
    topics.terms.sparkSession.range(1).select(F.lit(line).alias("value")).coalesce(1).write.text(f"{path}/description")


def load(spark: SparkSession, path: str) -> Topics:
    told = json.loads(spark.read.text(f"{path}/description").first()[0])
    return Topics(told["doc"], told["k"], spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/documents"), told["perplexity"])


def topic_terms(topics: Topics, n: int) -> DataFrame:
    """topic, term, weight of the ``n`` heaviest terms of each topic (k times n rows)."""
    each = topics.terms.select("term", F.posexplode("weights").alias("topic", "weight"))
    return top_per_group(each, "topic", n, F.desc("weight"), F.asc("term")).select("topic", "term", "weight")


def topic_weights(topics: Topics) -> DataFrame:
    """doc, topic, weight: every document's topic shares."""
    return topics.documents.select(topics.doc, F.posexplode("weights").alias("topic", "weight"))


def topic_documents(weights: DataFrame, doc: str, n: int) -> DataFrame:
    """The ``n`` documents with the largest share of each topic."""
    return top_per_group(weights, "topic", n, F.desc("weight"), F.asc(doc))


def document_topics(weights: DataFrame, doc: str, n: int) -> DataFrame:
    """The ``n`` largest topics of each document, chosen inside the document's group of k rows."""
    return top_per_group(weights, doc, n, F.desc("weight"), F.asc("topic"))


def fit_by(corpus: DataFrame, cohort: str, doc: str, describe: Callable[[Topics], DataFrame], **settings) -> DataFrame:
    """One model per cohort, each with its own vocabulary; ``describe`` results with the cohort added.

    Cohorts are few (years); their number is checked when they are listed.
    """
    values = classes_of(corpus, cohort)
    parts = [corpus.where(F.col(cohort) == value) for value in values]
    with ThreadPool(PARALLEL_FITS) as pool:  # fits side by side: each leaves most of a cluster idle between its rounds
        found = pool.map(lambda part: describe(fit(part, doc, **settings)), parts)
    named = [rows.withColumn(cohort, F.lit(value)) for rows, value in zip(found, values)]
    return reduce(DataFrame.unionByName, named)


def overview(terms: DataFrame) -> DataFrame:
    """topic, terms: one line per topic, heaviest terms first."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term")))
    return terms.groupBy("topic").agg(F.array_join(F.transform(ordered, lambda e: e["term"]), ",").alias("terms"))


def document_details(top_topics: DataFrame, topic_lines: DataFrame, meta: DataFrame, doc: str) -> DataFrame:
    """Each document's title, areas, and topics with weight and term list.

    ``topic_lines`` has one row per topic.
    """
    return top_topics.join(F.broadcast(topic_lines), "topic").join(meta, doc)


def topic_composition(top_docs: DataFrame, meta: DataFrame, doc: str, keys, min_weight: float = 0.1) -> DataFrame:
    """How the documents of each topic above ``min_weight`` fall into the classifications."""
    return composition(top_docs.where(F.col("weight") > min_weight).join(meta, doc), "topic", keys)


def topic_share(top_docs: DataFrame, meta: DataFrame, doc: str, condition: Column, min_weight: float = 0.1) -> DataFrame:
    """Share of documents fulfilling ``condition`` in each topic."""
    return share(top_docs.where(F.col("weight") > min_weight).join(meta, doc), "topic", condition)


def topics_used(weights: DataFrame, doc: str, min_weight: float) -> DataFrame:
    """n_topics, n_docs: how many documents use how many topics."""
    used = weights.groupBy(doc).agg(F.count_if(F.col("weight") > min_weight).alias("n_topics"))
    return used.groupBy("n_topics").agg(F.count("*").alias("n_docs"))


def topic_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """topic_a, topic_b, cosine of the topics' term weights, for pairs that share a term.

    A term occurs at most once per topic, so the join fans out by the number of
    topics only.
    """

    def lengths(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("topic").alias(f"topic_{name}")).agg(
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(f"_l{name}")
        )

    a = left.select(F.col("topic").alias("topic_a"), "term", F.col("weight").alias("_wa"))
    b = right.select(F.col("topic").alias("topic_b"), "term", F.col("weight").alias("_wb"))
    dots = a.join(b, "term").groupBy("topic_a", "topic_b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("_dot"))
    joined = dots.join(lengths(left, "a"), "topic_a").join(lengths(right, "b"), "topic_b")
    return joined.select("topic_a", "topic_b", (F.col("_dot") / (F.col("_la") * F.col("_lb"))).alias("cosine"))
