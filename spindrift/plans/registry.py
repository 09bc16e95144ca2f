"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Those whose rows are the same whatever the tables hold: tests run them, the entry doesn't register them.
FIXED: dict[str, Query] = {}
FIXED_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, fixed: bool = False) -> Callable[[Query], Query]:
    """Registers a function by its name, with the SQL for the same rows. ``fixed``: they don't depend on the tables."""

    def add(f: Query) -> Query:
        (FIXED if fixed else QUERIES)[f.__name__] = f
        if sql:
            (FIXED_ORACLES if fixed else ORACLES)[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else c for c in df.columns))


def literal_rows(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL that gives the rows: columns are names and types."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int | float) else "'" + str(v).replace("'", "''") + "'"
    lines = ", ".join(f"({', '.join(map(cell, r))})" for r in rows)
    return f"SELECT {', '.join(f'{c}::{t} AS {c}' for c, t in columns.items())} FROM (VALUES {lines}) t({', '.join(columns)})"
