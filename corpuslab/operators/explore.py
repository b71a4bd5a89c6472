"""Looking around in a corpus: contexts, neighbours, word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.joins import likely
from corpuslab.operators.ordering import top_n
from corpuslab.session import materialize


def concordance(corpus: DataFrame, doc: str, word: str, width: int, tokens: str = "tokens") -> DataFrame:
    """Every occurrence of ``word`` with up to ``width`` tokens on each side, cut inside the row."""
    t = F.col(tokens)
    hits = F.filter(F.transform(t, lambda x, i: F.when(x == word, i)), lambda i: i.isNotNull())

    def around(i):
        left = F.slice(t, F.greatest(i - width, F.lit(0)) + 1, F.least(i, F.lit(width)))
        right = F.slice(t, i + 2, F.lit(width))
        return F.struct(
            i.cast("long").alias("pos"),
            F.array_join(left, " ").alias("left"),
            F.lit(word).alias("word"),
            F.array_join(right, " ").alias("right"),
        )

    return corpus.select(doc, F.explode(F.transform(hits, around)).alias("_h")).select(doc, "_h.*")


def context_rows(corpus: DataFrame, tokens: str = "tokens", word: str | None = None) -> DataFrame:
    """term, left, right: a term (or ``word`` alone) with its two neighbours; empty at a text's ends."""
    t = F.col(tokens)
    at = F.transform(
        t,
        lambda x, i: F.struct(
            x.alias("term"),
            F.coalesce(F.get(t, i - 1), F.lit("")).alias("left"),
            F.coalesce(F.get(t, i + 1), F.lit("")).alias("right"),
        ),
    )
    if word is not None:
        at = F.filter(at, lambda c: c["term"] == word)
    return corpus.select(F.explode(at).alias("c")).select("c.*")


def similar_words(corpus: DataFrame, word: str, n: int, tokens: str = "tokens") -> DataFrame:
    """Words that share most contexts with ``word``.

    The word's own contexts are picked inside the row and written. A bit table of them drops most other rows before
    anything is shuffled; what is left is made distinct and joined to them.
    """
    every = context_rows(corpus, tokens)
    own = materialize(context_rows(corpus, tokens, word).select("left", "right").distinct(), "own_contexts")
    shared = likely(every.where(F.col("term") != word), own, "left", "right").distinct().join(own, ["left", "right"])  # a semi-join would be put before the table
    return top_n(shared.groupBy("term").agg(F.count("*").alias("n_shared")), n, F.desc("n_shared"), F.asc("term"))


def area_tokens(corpus: DataFrame, meta: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents with their area and tokens."""
    return corpus.join(meta, doc).select(doc, "area", "tokens")
