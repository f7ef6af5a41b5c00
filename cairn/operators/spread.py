"""Rows that cost much more than their bytes tell, dealt over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task gets on the average at most, where it holds all its keys.
ROWS_A_TASK = 1_000_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by hash of keys, in as many partitions as shuffles have: a file of few bytes may hold many rows, all in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread_by_count(rows: DataFrame, *keys: str, most: int = ROWS_A_TASK) -> DataFrame:
    """rows by hash of keys, in as many partitions as shuffles have, or more, so that each has about ``most`` rows.

    Aggregates by these keys then hold as much in a task at any size of table. Rows are counted first, so they should
    be cheap to count, as those of a Parquet table are.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))
    return rows.repartition(parts, *keys)
