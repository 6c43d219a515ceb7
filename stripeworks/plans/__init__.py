"""Named queries over the fixtures, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name."""
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six places, and no negative zero: what the engines agree on."""
    return F.round(c, 6) + 0.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def d6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0::DOUBLE as {name}"


def load() -> None:
    from . import flows, lines, maps, pixels, poses, records  # noqa: F401
