"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch, join_groups

PREFIX = 256


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: key, carry, keep_id, group_size (long), kept.

    Rows are equal when their texts are, null counting as empty; the row with the largest key
    stays. Refinement: (1) lengths that occur once end there, as singles; (2) of the rest,
    (length, hash of the first 256 characters) pairs that occur once end there; (3) only what
    survives has its full text hashed (SHA-256). The first two steps use a narrow table written
    once, so the texts are read twice: for lengths and prefixes, then by the survivors.

    Null keys are smaller than any other and a group of null keys has keep_id null with every row
    kept; rows that repeat the largest key of their group are all kept. Other columns of ``docs``
    are ignored unless named in ``carry``. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(
        F.col(key).alias("_key"), *carry, F.octet_length(body).alias("_length"),
        F.xxhash64(F.substring(body, 1, PREFIX)).alias("_prefix"), body.alias("_body"),
    )
    narrow = scratch.settle(sized.drop("_body"), "narrow")

    lengths = narrow.groupBy("_length").agg(F.count("*").alias("_n")).where("_n > 1")
    lengths = scratch.settle(lengths, "lengths")
    same_length = join_groups(narrow.select("_length", "_prefix"), lengths, ["_length"], "_n").where("_n is not null")
    prefixes = same_length.groupBy("_length", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1")
    prefixes = scratch.settle(prefixes, "prefixes")

    survivors = join_groups(sized.select("_key", *carry, "_length", "_prefix", "_body"), prefixes, ["_length", "_prefix"], "_n")
    hashed = survivors.where("_n is not null").select("_key", *carry, "_length", F.sha2("_body", 256).alias("_sha"))
    hashed = scratch.settle(hashed, "hashed")
    groups = hashed.groupBy("_length", "_sha").agg(F.max("_key").alias("_keep"), F.count("*").alias("_size"))
    groups = scratch.settle(groups.where("_size > 1"), "groups")

    repeated = join_groups(hashed, groups, ["_length", "_sha"], "_size").select("_key", *carry, "_keep", "_size")
    single = join_groups(narrow, prefixes, ["_length", "_prefix"], "_n").where("_n is null")
    single = single.select("_key", *carry, F.lit(None).cast(docs.schema[key].dataType).alias("_keep"), F.lit(None).cast("long").alias("_size"))
    return repeated.unionByName(single).select(
        F.col("_key").alias(key),
        *carry,
        F.when(F.col("_size").isNull(), F.col("_key")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_size").isNull() | F.col("_key").eqNullSafe(F.col("_keep"))).alias("kept"),
    )
