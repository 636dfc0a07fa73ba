"""Registered queries and their oracle SQL, by the operator they exercise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its equivalent in DuckDB SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """A double as both engines print it: six places, no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Every double of a result rounded."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema])


def sql6(*names: str) -> str:
    """The same in SQL."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def load() -> None:
    """Import the modules that register queries."""
    from skillgrid.plans import q_campaign, q_columns, q_contracts, q_functions, q_grid, q_products, q_quality, q_sources, q_stats, q_streaming, q_surface, q_time  # noqa: F401

