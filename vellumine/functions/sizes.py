"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows are at most this many; beyond it, the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if a count of at most a row over the bound proves it small, else as it is."""
    most = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
