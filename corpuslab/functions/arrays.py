"""Helpers for expressions over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression used inside a lambda would otherwise be evaluated again for
    every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def elements(values: Column | str, kind: str = "string") -> Column:
    """An array to explode, wrapped so that it is evaluated once.

    For a bare column the optimizer adds a "not empty" filter and pushes it down
    to the scan, where it would compute the array (here: tokenise the text) a
    second time.
    """
    values = F.col(values) if isinstance(values, str) else values
    return F.coalesce(values, F.array().cast(f"array<{kind}>"))
