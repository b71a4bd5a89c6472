"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch, join_groups, uniform
from corpuslab.operators.ordering import running_totals, with_row_index

MAX_COPIES = 3
PASSES = 4


def source_targets(sizes: DataFrame, share: float = 1.0, max_copies: int = MAX_COPIES, weight_cycle: int = 3) -> DataFrame:
    """source, source_size, target for a table (source, size) of documents.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...; together they are to give
    ``share`` of all words. A target stops at ``max_copies`` times its source; what that leaves over
    goes to the others by weight until none is above. That level is found in closed form: in order
    of cap per weight, a source is capped if everyone's demand at its own ratio fits the budget.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    totals = scratch.settle(totals, "totals")
    ranked = with_row_index(totals, F.asc_nulls_last("source"), name="_rank")
    ranked = ranked.select(
        "*", (F.col("_rank") % weight_cycle + 1).alias("_w"), (F.col("source_size") * max_copies).alias("_cap")
    ).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    ranked = scratch.settle(ranked, "ranked")
    running = running_totals(ranked, [F.col("_ratio"), F.col("_rank")], {"_caps": "_cap", "_weights": "_w"})
    overall = ranked.agg((F.sum("source_size") * F.lit(share)).alias("_budget"), F.sum("_w").alias("_all_w"))
    tested = running.crossJoin(F.broadcast(overall)).withColumn(  # one row
        "_capped", F.col("_caps") + F.col("_ratio") * (F.col("_all_w") - F.col("_weights")) <= F.col("_budget")
    )
    tested = scratch.settle(tested, "tested")
    left = tested.agg(
        F.max("_budget").alias("_b"),
        F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))), F.lit(0)).alias("_used"),
        F.coalesce(F.sum(F.when(~F.col("_capped"), F.col("_w"))), F.lit(0)).alias("_open"),
    )
    level = (F.col("_b") - F.col("_used")) / F.nullif(F.col("_open"), F.lit(0))
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(level * F.col("_w"))
    return tested.crossJoin(F.broadcast(left)).select("source", "source_size", "n_docs", target.alias("target"))


def mix(sizes: DataFrame, targets: DataFrame, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, carry, source_size, target, copies for (doc_id, source, size).

    A document is expected target / source_size times. The whole part is certain; the fraction f is
    the inclusion probability of one more copy. Those are drawn by Pareto order sampling: documents
    rank by (u / (1 - u)) / (f / (1 - f)), u uniform and fixed by doc_id and seed, and each source
    takes from the front while the words stay within what its target still lacks. The sample size is
    fixed in words, so later passes offer the gap that is left to the documents that still fit.

    Equal ids share their u, and repeated rows are separate documents. Sources without words take
    nothing, nor do documents without words beyond their whole copies.
    """
    scratch = Scratch(sizes.sparkSession, "mix")
    keyed = lambda df: df.withColumn("_key", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    goals = scratch.settle(keyed(targets).drop("source"), "goals")
    rows = join_groups(keyed(sizes.select("doc_id", "source", "size", *carry)), goals, ["_key", "_null"], "n_docs")
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    u = uniform("doc_id", seed=seed)
    rows = rows.withColumn("_ratio", ratio).withColumn("_whole", F.floor("_ratio"))
    rows = rows.withColumn("_f", F.col("_ratio") - F.col("_whole")).withColumn("_u", u)
    rows = rows.withColumn("_q", (F.col("_u") / (1 - F.col("_u"))) / F.nullif(F.col("_f") / (1 - F.col("_f")), F.lit(0.0)))
    rows = scratch.settle(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")

    pool = rows.where("_f > 0 and size > 0").select("_row", "_key", "_null", "size", "_q", "doc_id", F.col("n_docs"))
    gaps = goals.select("_key", "_null", "n_docs", (F.col("target") - F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))) * F.col("source_size")).alias("_gap"))
    gaps = scratch.settle(gaps.where("_gap > 0"), "gaps0")
    chosen = None
    for k in range(PASSES):
        fits = join_groups(pool, gaps.withColumnRenamed("n_docs", "_n"), ["_key", "_null"], "_n").where("size <= _gap")
        running = running_totals(fits, [F.col("_q"), F.col("doc_id"), F.col("size"), F.col("_row")], {"_sum": "size"}, by=["_key", "_null"])
        marked = scratch.settle(running.select("_row", "_key", "_null", "size", "_q", "doc_id", "n_docs", "_gap", (F.col("_sum") <= F.col("_gap")).alias("_in")), f"marked{k}")
        taken = marked.where("_in").select("_row")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        pool = marked.where("not _in").select(*pool.columns)
        spent = marked.groupBy("_key", "_null").agg(
            F.max("n_docs").alias("n_docs"), F.max("_gap").alias("_old"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("size"))), F.lit(0)).alias("_spent")
        )
        gaps = spent.select("_key", "_null", "n_docs", (F.col("_old") - F.col("_spent")).alias("_gap")).where("_gap > 0")
        gaps = scratch.settle(gaps, f"gaps{k + 1}")
    found = rows.join(chosen.withColumn("_extra", F.lit(1)), "_row", "left")
    copies = (F.col("_whole") + F.coalesce("_extra", F.lit(0))).cast("long")
    return found.select("doc_id", "source", "size", *carry, F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"))
