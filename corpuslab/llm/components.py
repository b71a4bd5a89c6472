"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch, join_groups


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of ``links`` (a, b: long).

    Every round writes the links anew, so nothing depends on an executor that may be lost, and no node's
    neighbours are gathered: only their minimum is.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.settle(both, f"{name}0")
    turn = 0
    while True:
        old = edges
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = scratch.settle(least.withColumn("m", F.least("m", "u")), f"{name}_large{turn}")
        large = join_groups(ways, least, ["u"], "n").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = scratch.settle(large, f"{name}_l{turn}")
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = scratch.settle(least, f"{name}_small{turn}")
        small = join_groups(edges, least, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.settle(small, f"{name}{turn + 1}")
        state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state(old) == state(edges):
            break
        turn += 1
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
