"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tallyloom.sources.tables import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql is the same result in DuckDB SQL."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def rule(name: str, source: str, key: str, made: dict[str, str], sql: dict[str, str]):
    """Registers a query of one row for each row of a table: its key and columns made of columns.

    made: columns in expressions that Spark and DuckDB share, which stand in for inputs that the tables lack; sql: the
    output columns in DuckDB SQL over them. The decorated function gives the output Columns by name.
    """
    inputs = ", ".join(f"{v} AS {k}" for k, v in made.items())
    outputs = ", ".join(f"{v} AS {k}" for k, v in sql.items())

    def add(function):
        def run(spark, d):
            rows = table(spark, d, source).select(key, *[F.expr(v).alias(k) for k, v in made.items()])
            return rows.select(key, *[c.alias(k) for k, c in function(*[F.col(k) for k in made]).items()])

        run.__doc__ = function.__doc__
        query(name, f"WITH t AS (SELECT {key}, {inputs} FROM {source}) SELECT {key}, {outputs} FROM t")(run)
        return function

    return add
