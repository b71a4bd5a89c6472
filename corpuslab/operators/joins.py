"""Joining rows to a table with one row per term, whatever the term frequencies are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.session import materialize

# A term is hot if it has at least one of so many rows; there are no more hot terms than that, and far fewer in text.
HOT_TERMS = 300_000
LANES = 1 << 17  # rows of 64 bits of a table that is sent to all tasks


def join_terms(rows: DataFrame, table: DataFrame, spread_by: str, weight: str, how: str = "inner", seen: DataFrame | None = None) -> DataFrame:
    """Add the columns of ``table`` (unique term, ``weight`` = its frequency) to ``rows``.

    Word frequencies are skewed: a few terms hold most rows. Terms above a share of all rows are broadcast, a bounded
    number, and the rows they match, like rows without a term, are not shuffled at all. The rest has no term with many
    rows and is a plain equi-join, which Spark turns into a broadcast when the table turns out small. Rows are written
    once before they part, so nothing is computed twice.

    What is hot is a matter of the rows: where ``table`` lacks terms the rows have, or counts something else, ``seen``
    (term, n = its number of rows) tells; a hot term that the table lacks then is a broadcast row without value.
    """
    table = table.where(F.col("term").isNotNull())
    value = F.struct(*[c for c in table.columns if c != "term"]).alias("_value")
    if seen is None:
        values = table.select("term", F.col(weight).alias("n"), value)
    else:
        values = seen.where(F.col("term").isNotNull()).select("term", "n").join(table.select("term", value), "term", "full")
    values = materialize(values, "term_values")
    least = values.agg(F.sum("n").alias("n")).scalar() / F.lit(HOT_TERMS)
    hot = values.where(F.col("n") >= least).select("term", "_value", F.lit(True).alias("_is_hot"))
    keyed = materialize(rows.join(F.broadcast(hot), "term", "left").select(*rows.columns, "_value", "_is_hot"), "keyed_rows")
    direct = F.col("_is_hot").isNotNull() | F.col("term").isNull()
    rest = values.where(F.col("_value").isNotNull()).select(F.col("term").alias("_key"), "_value")
    others = keyed.where(~direct).select(*rows.columns)
    others = others.join(rest, F.col("term") == F.col("_key"), how).select(*rows.columns, "_value")
    direct = keyed.where(direct & F.col("_value").isNotNull() if how == "inner" else direct)
    return direct.select(*rows.columns, "_value").unionByName(others).select(*rows.columns, "_value.*")


def likely(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """All ``rows`` whose ``keys`` are in ``wanted``, and others with the same mark in a table of 64 * LANES bits.

    Put before an exact join with few matches it keeps most of the other rows out of the shuffle.
    """
    code = F.xxhash64(*keys)
    lane, bit = F.pmod(code, F.lit(LANES)), F.shiftright(code, 40).bitwiseAND(F.lit(63)).cast("int")
    marks = wanted.select(lane.alias("_lane"), F.expr("1L").alias("_one"), bit.alias("_bit")).selectExpr("_lane", "shiftleft(_one, _bit) AS _mark")
    lanes = marks.groupBy("_lane").agg(F.bit_or("_mark").alias("_marks"))  # at most LANES rows
    met = rows.withColumn("_lane", lane).withColumn("_bit", bit).join(F.broadcast(lanes), "_lane")
    return met.where(F.expr("getbit(_marks, _bit) = 1")).select(*rows.columns)
