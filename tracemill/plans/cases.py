"""Fixture rows that a query and its SQL both join to a whole table, by a key modulo their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


def values_sql(rows: list[tuple], names: str) -> str:
    """The rows as a DuckDB subquery with a first column k that numbers them."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join([str(i), *map(_literal, r)]) + ')' for i, r in enumerate(rows))}) AS v(k, {names}))"


def cases_sql(table: str, key: str, rows: list[tuple], names: str) -> str:
    return f"(SELECT * FROM {table} JOIN {values_sql(rows, names)} AS c ON {key} % {len(rows)} = c.k)"


def with_cases(df: DataFrame, key: str, rows: list[tuple], names: str) -> DataFrame:
    """Every row of ``df`` with the fixture row whose number is ``key`` modulo their count; all fixture columns are strings."""
    schema = "k int, " + ", ".join(f"{n.strip()} string" for n in names.split(","))
    cases = df.sparkSession.createDataFrame([(i, *(None if x is None else str(x) for x in r)) for i, r in enumerate(rows)], schema)
    return df.join(F.broadcast(cases), F.pmod(F.col(key), F.lit(len(rows))) == F.col("k"))
