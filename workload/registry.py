"""Registry of the queries and shared helpers for them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with the SQL that must give the same rows."""
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round columns; adding zero turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(c), digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c) for c in df.columns
    ])


def r(expression: str, digits: int, name: str) -> str:
    """The SQL counterpart of ``rounded``."""
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def union(parts: Iterable[DataFrame]) -> DataFrame:
    out: DataFrame | None = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def union_sql(parts: Iterable[str]) -> str:
    return "\nUNION ALL\n".join(parts)
