"""Row numbers, running totals and top-n without a single-task global window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.session import materialize

_ROW_BITS = 33


def _sorted_in_parts(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition and sort, then pin each row's part and position.

    The result is written once: range boundaries come from a sample, so a second
    evaluation could place rows differently.
    """
    numbered = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    return materialize(
        numbered.select(
            *df.columns,
            F.shiftright("_at", _ROW_BITS).alias("_part"),
            F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_pos"),
        ),
        "sorted",
    )


def with_row_index(df: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """Number rows 0, 1, ... in a total order.

    Each range partition numbers its own rows; the offsets table has one row per
    partition, so only that table meets a global window.
    """
    parts = _sorted_in_parts(df, order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return parts.join(offsets, "_part").select(*df.columns, (F.col("_offset") + F.col("_pos")).cast("long").alias(name))


def running_totals(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Add inclusive running sums ``{new name: column}`` per group ``by`` in ``order``.

    A group may span many range partitions: each part is summed on its own and
    shifted by the totals of the parts before it, so no group sits in one task.
    """
    by = list(by)
    parts = _sorted_in_parts(df, [*[F.col(c) for c in by], *order])
    inside = Window.partitionBy("_part", *by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.select(*df.columns, "_part", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    part_sums = parts.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_sums.select(
        *by, "_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    joined = local.join(offsets, [*by, "_part"])
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in sums])


def top_per_group(df: DataFrame, by: str | Sequence[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank.

    Spark limits each group in every map task before the shuffle, so a hot group
    contributes at most n rows per task. That step needs a literal ``n`` right
    above the window.
    """
    by = [by] if isinstance(by, str) else list(by)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows overall (a bounded heap per task, then one merge)."""
    return df.orderBy(*order).limit(n)
