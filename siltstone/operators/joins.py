"""Joins whose form depends on a size that is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a side is sent to every executor.
BROADCAST_BYTES = 32 << 20


def join_checked(df: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """df joined with small, a written table whose rows take row_bytes at most.

    Where small has few enough rows, counted first, it is broadcast and df isn't shuffled; else both sides are.
    """
    if small.count() * row_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return df.join(small, on, how)
