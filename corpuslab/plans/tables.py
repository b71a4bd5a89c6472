"""The driver's tables, the corpus derived from them, and shared SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text
from corpuslab.functions.words import COUNTERS
from corpuslab.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents, spread over all cores when the file has too few splits."""
    rows = table(spark, folder, "documents")
    return spread(rows.select("doc_id", "text", *columns), "doc_id")


def corpus(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """doc_id, columns, tokens."""
    rows = documents(spark, folder, *columns)
    return rows.select("doc_id", *columns, text.content_tokens("text").alias("tokens"))


def labelled_corpus(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """doc_id, label, tokens of the labelled documents."""
    labels = table(spark, folder, "labels").select("doc_id", label)
    return documents(spark, folder).join(labels, "doc_id").select(
        "doc_id", label, text.content_tokens("text").alias("tokens")
    )


def cohort(doc: str = "doc_id") -> Column:
    """The collection has three years; ids are dealt to them in turn."""
    return (F.col(doc) % 3 + 2013).cast("int")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, label, vec as doubles."""
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def rating_rows(spark: SparkSession, folder: str) -> DataFrame:
    """user, item, rating: mean quantity a customer ordered of a part."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).agg(
        F.avg("l_quantity").alias("rating")
    )


# --- SQL the oracles share. Sharp s is upper-cased differently by the two engines.
UPPER = "upper(replace(text, 'ß', 'ss'))"
NORMAL = f"regexp_replace({UPPER}, '[^가-힣ㄱ-ㅎㅏ-ㅣA-Z0-9]', ' ', 'g')"
NUMBER = "[0-9]+(" + "|".join(dict.fromkeys(COUNTERS)) + ")?"
WORDS = f"list_filter(string_split({NORMAL}, ' '), lambda t: length(t) > 1 AND NOT regexp_full_match(t, '{NUMBER}'))"
DOCS = f"docs AS (SELECT *, {WORDS} AS tokens FROM documents)"
TOK = f"{DOCS}, tok AS (SELECT doc_id, lang, source, unnest(tokens) AS term FROM docs)"
TF = f"{TOK}, tf AS (SELECT doc_id, any_value(lang) AS lang, term, count(*) AS tf FROM tok GROUP BY doc_id, term)"
DF = f"{TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
BUCKET = "(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::INT % 100)"
VEC_BUCKET = "(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 4))::INT % 100)"
RATINGS = (
    "ratings AS (SELECT CAST(o_custkey AS INT) AS usr, CAST(l_partkey AS INT) AS item, avg(l_quantity) AS rating"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
)
