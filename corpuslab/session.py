"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "corpuslab", **extra: str) -> SparkSession:
    """A session with adaptive execution on; ``extra`` overrides single settings."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A temporary folder stands in only when the master is local: on a cluster it
    would exist on one machine alone.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    current = context.getCheckpointDir()
    if current is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslab-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Point the context at the shared folder before an iterative fit."""
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/corpuslab/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and where it lies."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Drop tables that ``written`` made and nothing reads any more, and let shuffle files of finished steps go.

    Spark removes those once the driver's garbage is collected.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    jvm.System.gc()


_SCRATCH = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop at the end what ``materialize`` writes meanwhile in this thread; what is to stay goes through ``written``."""
    outer, _SCRATCH.paths = getattr(_SCRATCH, "paths", None), []
    try:
        yield
    finally:
        paths, _SCRATCH.paths = _SCRATCH.paths, outer
        remove(spark, *paths)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where one result feeds several jobs, or where row positions must not
    change between two passes; the table outlives any executor.
    """
    table, path = written(df, name)
    if getattr(_SCRATCH, "paths", None) is not None:
        _SCRATCH.paths.append(path)
    return table


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when a small file yields fewer splits than there are cores.

    Large inputs have more splits than cores and pass through untouched, so no
    shuffle of the raw text is ever added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def dealt(spark: SparkSession, place: Column, n: int) -> Column:
    """Numbers for ``place`` (0 to n - 1), one each, which ``repartition(n, ...)`` by them deals to ``n`` different partitions."""
    ids = spark.range(16 * n + 64).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id"))
    found = dict(ids.collect())  # n rows
    return F.get(F.array(*[F.lit(found.get(i, 16 * n + 64 + i)).cast("long") for i in range(n)]), place.cast("int"))
