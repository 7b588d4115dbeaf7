"""Broadcasts only of tables whose rows were counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 100_000


def small(table: DataFrame, rows: int = ROWS) -> DataFrame:
    """The table, to be broadcast if it has at most that many rows; beyond, an equi-join with it is left to shuffle."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def bounded(table: DataFrame, what: str, rows: int = ROWS) -> DataFrame:
    """The table, to be broadcast, for joins that aren't on equal keys: more rows than the bound are an error."""
    if table.limit(rows + 1).count() > rows:
        raise ValueError(f"{what}: more than {rows} rows can't go to every task")
    return F.broadcast(table)
