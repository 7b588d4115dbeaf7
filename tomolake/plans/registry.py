"""Queries with, where SQL can express them, the statement that DuckDB holds against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, as in the statements; no negative zero."""
    return df.select(*[(F.round(c, PLACES) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
