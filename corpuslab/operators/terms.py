"""Term counts and weights.

A document's tokens are counted inside its row, so the (doc, term, tf) table
needs no shuffle; only per-term tables do, after map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.arrays import elements
from corpuslab.operators.joins import join_terms
from corpuslab.operators.ordering import top_n, top_per_group, with_row_index
from corpuslab.session import materialize


def term_frequencies(corpus: DataFrame, *keep: str, tokens: str = "tokens", keep_empty: bool = False) -> DataFrame:
    """Columns ``keep``, term, tf. ``keep_empty`` keeps token-less documents with a null term.

    Tokens are sorted in the row; each run of equal tokens becomes one output row.
    """
    ordered = corpus.select(*keep, F.sort_array(tokens).alias("_s"))
    n = F.size("_s")
    starts = ordered.select(
        *keep,
        "_s",
        F.filter(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)),
        ).alias("_from"),
    )
    to = F.concat(F.slice("_from", F.lit(2), F.size("_from")), F.array(n))
    runs = F.zip_with(
        "_from",
        F.when(n > 0, to).otherwise(F.array().cast("array<int>")),
        lambda a, b: F.struct(F.get("_s", a).alias("term"), (b - a).cast("long").alias("tf")),
    )
    explode = F.explode_outer if keep_empty else F.explode
    return starts.select(*keep, explode(runs).alias("_e")).select(*keep, "_e.term", "_e.tf")


def occurrences(corpus: DataFrame, *keep: str, tokens: str = "tokens") -> DataFrame:
    """One row per token: ``keep``, pos, term."""
    return corpus.select(*keep, F.posexplode(elements(tokens)).alias("pos", "term"))


def collection_frequencies(corpus: DataFrame, tokens: str = "tokens") -> DataFrame:
    """term, cf: occurrences over the whole corpus."""
    return corpus.select(F.explode(elements(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("cf"))


def document_frequencies(corpus: DataFrame, tokens: str = "tokens") -> DataFrame:
    """term, df: documents that contain the term."""
    distinct = corpus.select(F.explode(F.array_distinct(tokens)).alias("term"))
    return distinct.groupBy("term").agg(F.count("*").alias("df"))


def area_document_frequencies(corpus: DataFrame, area: str, tokens: str = "tokens") -> DataFrame:
    """area, term, n_docs: documents of the area that contain the term."""
    distinct = corpus.select(area, F.explode(F.array_distinct(tokens)).alias("term"))
    return distinct.groupBy(area, "term").agg(F.count("*").alias("n_docs"))


def document_lengths(corpus: DataFrame, *keep: str, tokens: str = "tokens") -> DataFrame:
    """Distinct and total token counts of each document."""
    return corpus.select(
        *keep,
        F.size(F.array_distinct(tokens)).cast("long").alias("n_unique"),
        F.size(tokens).cast("long").alias("n_total"),
    )


def corpus_totals(corpus: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: documents, tokens, distinct tokens."""
    by_term = collection_frequencies(corpus, tokens).agg(
        F.sum("cf").alias("n_tokens"), F.count("*").alias("n_terms")
    )
    return by_term.select("n_tokens", "n_terms", number_of(corpus).alias("n_docs"))


def count_of(corpus: DataFrame, word: str, tokens: str = "tokens") -> DataFrame:
    """How often one word occurs, and in how many documents."""
    hits = F.size(F.filter(tokens, lambda t: t == word))
    return corpus.agg(F.coalesce(F.sum(hits), F.lit(0)).cast("long").alias("n"), F.count_if(hits > 0).alias("n_docs"))


def number_of(rows: DataFrame) -> Column:
    """Row count as a scalar subquery: evaluated once, no join."""
    return rows.agg(F.count("*").alias("n")).scalar()


def top_terms(frequencies: DataFrame, n: int, by: str = "df") -> DataFrame:
    """The ``n`` most frequent terms; ties by term."""
    return top_n(frequencies, n, F.desc(by), F.asc("term"))


def drop_top_terms(frequencies: DataFrame, n: int, stop_words: Sequence[str] = (), by: str = "cf") -> DataFrame:
    """All terms but the ``n`` most frequent and the stop words.

    The dropped table has ``n`` rows, a parameter, so it is safe to broadcast.
    """
    dropped = top_terms(frequencies, n, by).select("term")
    kept = frequencies.join(F.broadcast(dropped), "term", "left_anti")
    return kept.where(~F.col("term").isin(list(stop_words))) if stop_words else kept


def term_index(terms: DataFrame, *order: Column, name: str = "term_id") -> DataFrame:
    """Give each distinct term an id 0, 1, ... in a fixed order (by term unless told otherwise)."""
    return with_row_index(terms, *(order or (F.asc("term"),)), name=name)


def count_triplets(corpus: DataFrame, index: DataFrame, doc: str, tokens: str = "tokens") -> DataFrame:
    """doc, term_id, tf. An index that kept the terms' df is joined with hot terms scattered."""
    counted = term_frequencies(corpus, doc, tokens=tokens)
    joined = join_terms(counted, index, doc, "df") if "df" in index.columns else counted.join(index, "term")
    return joined.select(doc, "term_id", "tf")


def idf(frequencies: DataFrame, n_docs: Column) -> DataFrame:
    """term, df, idf = ln(N / df)."""
    return frequencies.select("term", "df", F.log(n_docs / F.col("df").cast("double")).alias("idf"))


def smoothed_idf(frequencies: DataFrame, n_docs: Column, min_df: int = 0) -> DataFrame:
    """term, df, idf = ln((N + 1) / (df + 1)); 0 below ``min_df``."""
    value = F.log((n_docs + 1) / (F.col("df") + 1).cast("double"))
    return frequencies.select("term", "df", F.when(F.col("df") >= min_df, value).otherwise(F.lit(0.0)).alias("idf"))


def tfidf(corpus: DataFrame, doc: str, num_terms: int, tokens: str = "tokens") -> DataFrame:
    """doc, term, weight = idf * tf / tokens in the document, for the top ``num_terms`` terms by df.

    The denominator counts all tokens, also those outside the kept terms. The
    most frequent of the kept terms are broadcast, see ``join_terms``.
    """
    kept = idf(top_terms(document_frequencies(corpus, tokens), num_terms), number_of(corpus))
    counted = term_frequencies(corpus.withColumn("_total", F.size(tokens)), doc, "_total", tokens=tokens)
    weight = F.col("idf") * F.col("tf") / F.col("_total")
    return join_terms(counted, kept, doc, "df").select(doc, "term", weight.alias("weight"))


def tfidf_unit(
    corpus: DataFrame,
    doc: str,
    tokens: str = "tokens",
    sublinear: bool = False,
    max_df: float = 1.0,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """doc, term, weight: tf * (ln((1 + N) / (1 + df)) + 1), each document scaled to length 1.

    ``sublinear`` replaces tf by 1 + ln(tf); terms in more than ``max_df`` of the
    documents are left out.
    """
    n_docs = number_of(corpus)
    if stop_words:  # in the row, before anything is shuffled
        corpus = corpus.withColumn(tokens, F.filter(tokens, lambda t: ~t.isin(list(stop_words))))
    every = document_frequencies(corpus, tokens)
    terms = every.where(F.col("df") <= F.lit(max_df) * n_docs)
    terms = terms.select("term", "df", (F.log((n_docs + 1) / (F.col("df") + 1).cast("double")) + 1).alias("idf"))
    tf = (F.log(F.col("tf").cast("double")) + 1) if sublinear else F.col("tf").cast("double")
    counted = term_frequencies(corpus, doc, tokens=tokens)
    seen = every.select("term", F.col("df").alias("n"))
    weighted = join_terms(counted, terms, doc, "df", seen=seen).select(doc, "term", (tf * F.col("idf")).alias("_w"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return weighted.select(doc, "term", (F.col("_w") / length).alias("weight"))


def top_terms_per_area(area_frequencies: DataFrame, area: str, n: int) -> DataFrame:
    return top_per_group(area_frequencies, area, n, F.desc("n_docs"), F.asc("term"))


def similar_documents(weights: DataFrame, doc: str, query, n: int) -> DataFrame:
    """The ``n`` documents closest to one document by cosine of their weights.

    Only the query document's terms are joined; one document's terms are a
    bounded table. The weights are used several times and written once.
    """
    weights = materialize(weights, "weights")
    wanted = F.broadcast(weights.where(F.col(doc) == query).select("term", F.col("weight").alias("_q")))
    length = weights.groupBy(doc).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_len"))
    dots = weights.join(wanted, "term").groupBy(doc).agg(F.sum(F.col("weight") * F.col("_q")).alias("_dot"))
    query_length = length.where(F.col(doc) == query).select("_len").scalar()
    score = F.col("_dot") / (F.col("_len") * query_length)
    return top_n(dots.join(length, doc).select(doc, score.alias("score")), n, F.desc(F.round("score", 6)), F.asc(doc))
