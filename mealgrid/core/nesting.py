"""Nested array cells of bounded size.

A nested relation shows the lines of a recipe or product as one array. The key of such a relation is (key, page): page k
holds the lines at positions k * ``PAGE_ENTRIES`` onward of the relation's own order, for every key and at every size.
Lines are placed by a window, which passes over a large key without holding it; only one page is ever an array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_ENTRIES = 10_000


def add_page(df: DataFrame, keys: Sequence[str], order: Mapping[str, Column], entries: int = PAGE_ENTRIES) -> DataFrame:
    """Add ``page``: the position of the row within its key, in the given total order, over ``entries``.

    The shuffle by key also serves the aggregation by (key, page) that follows.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order.values()))
    return df.withColumn("page", F.floor((position - 1) / F.lit(entries)).cast("int"))


def nested(order: Mapping[str, Column], fields: Mapping[str, Column], when: Column | None = None) -> Column:
    """Aggregate expression: array of ``fields`` structs sorted by ``order``; empty when no row qualifies."""
    sort_key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order.values())])
    payload = F.struct(*[c.alias(n) for n, c in fields.items()])
    entry = F.struct(sort_key.alias("k"), payload.alias("v"))
    if when is not None:
        entry = F.when(when, entry)
    return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"])
