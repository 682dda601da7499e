"""Even work for stages that compute much per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows spread by hash over as many tasks as a shuffle uses.

    For compute-heavy steps over little data: partitions sized by bytes alone would put a whole
    table of short texts into one task, or one very long text next to many short ones.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *columns)
