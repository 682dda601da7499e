"""Measured size before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
ROW_OVERHEAD = 32


def text_bytes(df: DataFrame) -> int:
    """Approximate size of a frame of numbers and texts: one aggregate row comes back."""
    lengths = F.lit(ROW_OVERHEAD * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            lengths = lengths + F.coalesce(F.octet_length(name), F.lit(0))
    return df.agg(F.coalesce(F.sum(lengths), F.lit(0)).alias("n")).first().n


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its measured size is within the limit, else unchanged.

    Beyond the limit the join shuffles both sides, with the same result.
    """
    return F.broadcast(df) if text_bytes(df) <= limit else df
