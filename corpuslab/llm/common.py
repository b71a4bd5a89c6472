"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import new_path

# White space that separates words; everything else belongs to a word.
GAP = "[\\x20\\x09-\\x0D]+"
HOT_GROUPS = 1000
LANES = 1 << 17  # rows of 64 bits


class Scratch:
    """Tables one job writes below ``spark.checkpoint.dir`` and may drop again.

    A written table outlives any executor and is computed once. Writing also lets
    the driver collect its garbage, so that the shuffle files of finished steps go.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column | str) -> Column:
    """Words of a text between ASCII white space; null gives none."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def uniform(*columns: Column | str, seed: str = "") -> Column:
    """A number in (0, 1) that depends on the columns only, so reruns agree."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("?")) for c in columns])
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (one row per key, ``weight`` = its number of rows).

    The heaviest groups, a fixed number, are broadcast; their rows get a scattered key for the
    second join, so no task holds a hot group. Keys must not be null. ``groups`` is used twice
    and should be a written table.
    """
    value = F.struct(*[c for c in groups.columns if c not in keys])
    hot = groups.orderBy(F.desc(weight), *keys).limit(HOT_GROUPS).select(*keys, value.alias("_hot"))
    keyed = rows.join(F.broadcast(hot), list(keys), "left")
    scattered = F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0))
    keyed = keyed.withColumn("_salt", scattered)
    rest = groups.select(*keys, F.lit(0).cast("long").alias("_salt"), value.alias("_rest"))
    found = keyed.join(rest, [*keys, "_salt"], "left").withColumn("_value", F.coalesce("_hot", "_rest"))
    return found.select(*[F.col(c) for c in rows.columns], "_value.*")


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """All ``rows`` whose ``key`` is in ``wanted``, and others with the same mark in a table of 64 * LANES bits."""
    code = F.xxhash64(key)
    lane, bit = F.pmod(code, F.lit(LANES)), F.shiftright(code, 40).bitwiseAND(F.lit(63)).cast("int")
    marks = wanted.select(lane.alias("_lane"), F.expr("1L").alias("_one"), bit.alias("_bit")).selectExpr("_lane", "shiftleft(_one, _bit) AS _mark")
    lanes = marks.groupBy("_lane").agg(F.bit_or("_mark").alias("_marks"))  # at most LANES rows
    met = rows.withColumn("_lane", lane).withColumn("_bit", bit).join(F.broadcast(lanes), "_lane")
    return met.where(F.expr("getbit(_marks, _bit) = 1")).select(*rows.columns)
