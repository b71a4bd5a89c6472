"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.arrays import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(values: Column | str) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two equally long arrays."""
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a: Column | str) -> Column:
    """Array divided by its length; null for a zero row, which has no direction."""
    a = _col(a)
    return let(F.nullif(norm(a), F.lit(0.0)), lambda n: F.transform(a, lambda x: x / n))


def scale(a: Column | str, diagonal: Column | str) -> Column:
    """Row times diagonal matrix."""
    return F.zip_with(_col(a), _col(diagonal), lambda x, s: x * s)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def doubles(a: Column | str) -> Column:
    """Cast a float array to doubles before any arithmetic."""
    return _col(a).cast("array<double>")


def sparse_vector(size: Column | int, indices: Column | str, values: Column | str) -> Column:
    """An ML sparse vector from sorted index and value arrays.

    ``from_json`` reads the vector's own struct form, so the column is built in
    the JVM without a Python worker and without a vocabulary on the driver.
    """
    size = F.lit(size) if isinstance(size, int) else size
    body = F.struct(
        F.lit(0).cast("byte").alias("type"),
        size.cast("int").alias("size"),
        _col(indices).cast("array<int>").alias("indices"),
        _col(values).cast("array<double>").alias("values"),
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(body.alias("v"))), schema)["v"]
