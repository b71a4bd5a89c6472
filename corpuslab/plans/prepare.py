"""From raw text and metadata to the prepared corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text
from corpuslab.functions.words import STOP_WORDS, TRANSLATIONS
from corpuslab.operators.categories import without_documents
from corpuslab.sources.readers import load_or_build


def corpus(documents: DataFrame, blocked: DataFrame | None = None, *keep: str) -> DataFrame:
    """doc_id, keep, tokens: words translated, title words added, stop words dropped.

    ``documents`` has doc_id, text and title. Everything but the removal of
    blocked documents happens inside a row.
    """
    rows = documents if blocked is None else without_documents(documents, blocked)
    body = text.translate_tokens(text.content_tokens("text"), TRANSLATIONS)
    full = text.append_title(body, "title")
    return rows.select("doc_id", *keep, text.drop_stop_words(full, STOP_WORDS).alias("tokens"))


def prepared_corpus(spark: SparkSession, path: str, documents: DataFrame, year: int | None = None) -> DataFrame:
    """The prepared corpus stored at ``path``, built on first use; optionally of one year."""
    stored = load_or_build(spark, path, lambda: corpus(documents))
    return stored if year is None else stored.where(F.col("doc_id").cast("string").startswith(str(year)))
