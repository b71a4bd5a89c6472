"""Run a query and its SQL side by side and compare the results value by value."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def _kind(name: str) -> str:
    name = name.lower()
    groups = {
        "int": ("tinyint", "smallint", "int", "integer", "byte", "short"),
        "long": ("bigint", "long"),
        "double": ("double",),
        "string": ("string", "varchar"),
        "bool": ("boolean",),
    }
    return next((g for g, names in groups.items() if name in names), name)


def compare(spark, connection, folder: str, function, sql: str) -> str | None:
    """None when both agree, else what differs."""
    frame = function(spark, folder)
    order = sorted(frame.columns)
    mine = sorted(tuple(_cell(v) for v in row) for row in frame.select(*order).collect())
    relation = connection.sql(sql)
    if sorted(relation.columns) != order:
        return f"columns {order} against {sorted(relation.columns)}"
    types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    spark_types = {f.name: f.dataType.simpleString() for f in frame.schema}
    for name in order:
        if _kind(types[name]) != _kind(spark_types[name]):
            return f"type of {name}: {spark_types[name]} against {types[name]}"
    at = [relation.columns.index(c) for c in order]
    theirs = sorted(tuple(_cell(row[i]) for i in at) for row in relation.fetchall())
    if not mine:
        return "no rows"
    if mine == theirs:
        return None
    odd = [(a, b) for a, b in zip(mine, theirs) if a != b][:3]
    return f"{len(mine)} rows against {len(theirs)}, first differences {odd}"


def main(names, folder):
    import sys

    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from corpuslab import build_session

    spark = build_session(
        "agreement", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                        "spark.ui.showConsoleProgress": "false", "spark.log.level": "OFF"}
    )
    connection = database(folder)
    every, oracles = entry.queries(), entry.oracle_sql()
    for name in names or every:
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, connection, folder, every[name], oracles[name]) or "ok"
            else:
                result = f"rows only: {len(every[name](spark, folder).collect())}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__} {str(error)[:700]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    import sys

    main(sys.argv[2:], sys.argv[1])
