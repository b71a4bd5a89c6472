"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from corpuslab.llm.common import Scratch, word_count
from corpuslab.llm.queries import tokenizer_path

# The model of the toxicity stage and the packing plan have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def _same(left: DataFrame, right: DataFrame, h: str):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left[h] == right[h])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model of the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_rows(docs, toxicity.fit(docs, labels))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; of rows equal in id and text, one. Null texts are empty, a null id is
    the smallest; other columns stay, whatever their names; an empty table stays empty.
    """
    scratch = Scratch(spark, "stage_exact")
    (h,) = _free(docs, "_h")
    keyed = docs.withColumn(h, _text_key())
    groups = scratch.settle(exact_dedup.exact_groups(keyed, carry=[h]), "groups")
    gone = groups.where("not kept").select("doc_id", h).distinct()
    rows = groups.where("kept and group_size > 1").groupBy("doc_id", h).count()
    repeated = scratch.settle(rows.where("count > 1").select("doc_id", h), "repeated")
    gone = scratch.settle(gone.unionByName(repeated).distinct(), "gone")
    kept = keyed.join(gone, _same(keyed, gone, h), "left_anti").drop(h)
    if not repeated.isEmpty():
        again = keyed.join(repeated, _same(keyed, repeated, h), "left_semi").dropDuplicates(["doc_id", h]).drop(h)
        kept = kept.unionByName(again)
    return kept


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    found = ngram_join.near_duplicates(docs)
    heads = F.max(F.col("component_id").eqNullSafe(F.col("doc_id")))
    gone = Scratch(spark, "stage_near").settle(found.groupBy("doc_id").agg(heads.alias("head")).where("not head").select("doc_id"), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Null texts have no words; rows equal in id and text count once; other
    columns stay, whatever their names; an empty table stays empty.
    """
    scratch = Scratch(spark, "stage_mix")
    h, i, k, copies, copy = _free(docs, "_h", "_id", "_k", "_copies", "_copy")
    sizes = scratch.settle(docs.select("doc_id", "source", _text_key().alias("hash"), word_count("text").alias("size")), "sizes")
    mixed = mixing.mix(sizes, mixing.source_targets(sizes), carry=["hash"])
    taken = mixed.groupBy("doc_id", "hash").agg(F.max("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    taken = scratch.settle(taken.select(F.col("doc_id").alias(i), F.col("hash").alias(k), copies), "taken")
    keyed = docs.withColumn(h, _text_key())
    joined = keyed.join(taken, keyed["doc_id"].eqNullSafe(taken[i]) & (keyed[h] == taken[k]))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("n-gram Jaccard join", drop_near),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.settle(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
