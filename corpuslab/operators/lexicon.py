"""Table-driven morphology: a lexicon of word analyses is joined to the terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import drop_numbers
from corpuslab.operators.joins import join_terms


def resolve(lexicon: DataFrame, pos: str = "N") -> DataFrame:
    """Per surface form, the words it stands for.

    ``lexicon`` has surface, rank, pos, stem and parts. With several noun
    analyses the first stem counts; with one, its compound parts if there are
    at least two, else its stem. Words of one character, numbers and counters
    are left out. Analyses of one word form are few by nature.
    """
    nouns = lexicon.where(F.col("pos") == pos).groupBy("surface").agg(
        F.count("*").alias("_n"), F.min(F.struct("rank", "stem", "parts")).alias("_a")
    )
    compound = (F.col("_n") == 1) & (F.size("_a.parts") > 1)
    words = F.when(compound, F.col("_a.parts")).otherwise(F.array("_a.stem"))
    long_enough = F.filter(words, lambda w: F.length(w) > 1)
    return nouns.select("surface", drop_numbers(long_enough).alias("words"))


def lexicon_terms(frequencies: DataFrame, lexicon: DataFrame, used: DataFrame, doc: str, pos: str = "N") -> DataFrame:
    """doc, term, tf after replacing each surface form by its words.

    Works on counted terms, so each form of a document is looked up once. Forms
    without a noun analysis drop out. ``used`` has term and df: it tells which
    forms are hot.
    """
    words = resolve(lexicon, pos).withColumnRenamed("surface", "term")
    found = join_terms(frequencies, words, doc, "df", seen=used.select("term", F.col("df").alias("n")))
    words = found.select(doc, F.explode("words").alias("term"), "tf")
    return words.groupBy(doc, "term").agg(F.sum("tf").alias("tf"))


def compound_parts(lexicon: DataFrame) -> DataFrame:
    """surface, part for every analysis with compound parts."""
    return lexicon.where(F.size("parts") > 1).select("surface", F.explode("parts").alias("part")).distinct()


def lemmas(
    frequencies: DataFrame, lemma_table: DataFrame, used: DataFrame, doc: str, stop_words, min_length: int = 3
) -> DataFrame:
    """doc, term, tf of lower-case lemmas: letters only, long enough, not a stop word.

    ``lemma_table`` has one lemma per surface form, ``used`` term and df.
    """
    lemma = F.lower(F.coalesce("lemma", "term"))
    table = lemma_table.withColumnRenamed("surface", "term")
    seen = used.select("term", F.col("df").alias("n"))
    mapped = join_terms(frequencies, table, doc, "df", "left", seen).select(doc, lemma.alias("term"), "tf")
    keep = (
        (F.length("term") >= min_length)
        & F.col("term").rlike(r"^\p{L}+$")
        & ~F.col("term").isin(list(stop_words))
    )
    return mapped.where(keep).groupBy(doc, "term").agg(F.sum("tf").alias("tf"))
