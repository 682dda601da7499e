"""Consecutive numbering of a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mealgrid.core.scratch import durable

_WITHIN_BITS = 33  # monotonically_increasing_id keeps the row position in its lower 33 bits


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Number rows 1..N in the given total order.

    Rows are range-partitioned and sorted once, stored durably (so both passes below see the same
    split), and each range adds the row counts of the ranges before it. Only one row per range,
    never data, goes through the running-sum window.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = durable(
        sorted_rows.withColumn("__mid", F.monotonically_increasing_id())
        .withColumn("__range", F.shiftright("__mid", _WITHIN_BITS))
        .withColumn("__pos", F.col("__mid") - F.shiftleft("__range", _WITHIN_BITS))
        .drop("__mid")
    )
    sizes = marked.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (
        marked.join(offsets, "__range")
        .withColumn(name, F.col("__offset") + F.col("__pos") + F.lit(1))
        .drop("__range", "__pos", "__offset")
    )
