"""Registry of runnable queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``; ``oracle`` is the DuckDB text."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def nudge(digits: int) -> float:
    """Moves exact decimal halves off the tie, the same way in both engines."""
    return 3.7 * 10.0 ** -(digits + 4)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so results compare across engines."""
    cols: list[Column] = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append((F.round(F.col(f.name) + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
