"""Rows dealt by their keys over as many tasks as they need, so that what a task holds doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task gets on average at most; left to itself, Spark deals small shuffles over as many tasks as there are cores.
TASK_ROWS = 250_000


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` dealt by ``keys`` for a table of ``rows`` rows; sides of a join that state the same number meet without another shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
