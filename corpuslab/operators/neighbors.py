"""Nearest rows and centroids in dense vector tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.vectors import dot, squared_distance, unit
from corpuslab.operators.features import MAX_CLASSES
from corpuslab.operators.ordering import top_n, top_per_group

# Rows per block of the blocked nearest-neighbour join: a block of 64-dimensional
# vectors stays near 2 MB. Scores are found for so many queries of a tile at a time
# that their matrix stays near 8 MB.
BLOCK_ROWS = 4096
TILE_QUERIES = 256


def nearest_to(rows: DataFrame, key: str, vector: str, query, n: int) -> DataFrame:
    """The ``n`` rows closest to one row by cosine, itself included; zero rows have no direction and are left out."""
    units = rows.select(key, unit(vector).alias("_u")).where(F.get("_u", F.lit(0)).isNotNull())
    wanted = units.where(F.col(key) == query).select("_u").scalar()
    # The subquery becomes a column first: lambdas may not contain one.
    scored = units.select(key, "_u", wanted.alias("_q")).select(key, dot("_u", "_q").alias("score"))
    return top_n(scored, n, F.desc(F.round("score", 6)), F.asc(key))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each class, from partial sums."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return rows.groupBy(label).agg(vector_to_array(mean).alias("centroid"))


def nearest_centroid(train: DataFrame, test: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """key, label, classes[], scores[]: negative squared distance to each class centroid.

    The centroids form one array, read through a scalar subquery; their number is
    the number of classes, which is checked.
    """
    found = centroids(train, label, vector)
    listed = found.agg(F.sort_array(F.collect_list(F.struct(label, "centroid"))).alias("c"))
    guarded = listed.select(
        F.when(F.size("c") <= MAX_CLASSES, F.col("c")).otherwise(F.raise_error(F.lit("too many classes"))).alias("c")
    ).scalar()
    return test.select(key, label, vector, guarded.alias("_c")).select(
        key,
        label,
        F.transform("_c", lambda c: c[label]).alias("classes"),
        F.transform("_c", lambda c: -squared_distance(c["centroid"], vector)).alias("scores"),
    )


def knn_join(
    queries: DataFrame, rows: DataFrame, query_key: str, key: str, vector: str, k: int, carry: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_key, key, carry, dist2: for every query its ``k`` nearest rows.

    Blocked join: both sides are hashed into blocks of about ``block_rows`` rows
    and each pair of blocks is one small group, scored by a matrix product and
    cut to k rows per query, a few queries at a time. No task sees more than two blocks,
    and all blocks meet, so the result is exact. ``carry`` is a column kept from ``rows``.
    """
    n_query = -(-max(queries.count(), 1) // block_rows)
    n_row = -(-max(rows.count(), 1) // block_rows)
    left = queries.select(
        F.col(query_key).alias("qid"), F.col(vector).alias("vec"), F.pmod(F.xxhash64(query_key), F.lit(n_query)).alias("bq")
    ).withColumn("br", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_row - 1).cast("long"))))
    right = rows.select(
        F.col(key).alias("rid"),
        F.col(vector).alias("vec"),
        F.col(carry).alias("carry"),
        F.pmod(F.xxhash64(key), F.lit(n_row)).alias("br"),
    ).withColumn("bq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long"))))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"qid": [], "rid": [], "carry": [], "dist2": []})
        every, r = np.stack(a["vec"].to_numpy()), np.stack(b["vec"].to_numpy())
        query_ids, ids, carried = a["qid"].to_numpy(), b["rid"].to_numpy(), b["carry"].to_numpy()
        lengths, take, found = (r * r).sum(1), min(k, len(ids)), []
        for start in range(0, len(every), TILE_QUERIES):
            q = every[start : start + TILE_QUERIES]
            rough = (q * q).sum(1)[:, None] + lengths[None, :] - 2.0 * q @ r.T
            # The product form loses digits in proportion to the squared lengths, wherever the k-th distance lies: keep
            # everything within that of it, then rank by the differences themselves.
            limit = np.partition(rough, take - 1, axis=1)[:, take - 1]
            slack = 1e-12 * q.shape[1] * ((q * q).sum(1) + lengths.max())
            at, near = np.nonzero(rough <= (limit + slack)[:, None])
            exact = ((r[near] - q[at]) ** 2).sum(1)
            order = np.lexsort((ids[near], exact, at))
            at, near, exact = at[order], near[order], exact[order]
            first = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
            best = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) < take
            at, near, exact = at[best], near[best], exact[best]
            found.append(pd.DataFrame({"qid": query_ids[start + at], "rid": ids[near], "carry": carried[near], "dist2": exact}))
        return pd.concat(found, ignore_index=True)

    types = {"qid": queries.schema[query_key], "rid": rows.schema[key], "carry": rows.schema[carry]}
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in types.items()) + ", dist2 double"
    tiles = left.groupBy("bq", "br").cogroup(right.groupBy("bq", "br")).applyInPandas(tile, schema)
    best = top_per_group(tiles, "qid", k, F.asc("dist2"), F.asc("rid"))
    return best.select(F.col("qid").alias(query_key), F.col("rid").alias(key), F.col("carry").alias(carry), "dist2", "rank")


def knn_classify(train: DataFrame, test: DataFrame, key: str, label: str, vector: str, k: int = 10) -> DataFrame:
    """key, prediction: majority label of the k nearest training rows, the smallest label on ties."""
    near = knn_join(
        test.select(F.col(key).alias("_q"), vector), train.select(key, vector, label), "_q", key, vector, k, label
    )
    votes = near.groupBy("_q", label).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("v")))
    return votes.groupBy("_q").agg(best.alias("b")).select(F.col("_q").alias(key), F.col("b.v").alias("prediction"))
