"""First-row, top-n and page selection per key.

All of them filter ``row_number()`` by an upper bound, which Spark plans as a group limit in two
steps: each task keeps at most ``n`` rows of a key *before* the shuffle, so a key that owns a
large share of the table still sends only ``n`` rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64
_RANK = "__rank"


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of every key in the given total order, numbered from 1 in ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Like :func:`ranked`, without the rank column."""
    return ranked(df, keys, order, n, _RANK).drop(_RANK)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given total order."""
    return top_n(df, keys, order, 1)


def page(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, skip: int = 0) -> DataFrame:
    """Rows ``skip+1 … skip+n`` of every key."""
    return ranked(df, keys, order, skip + n, _RANK).filter(F.col(_RANK) > skip).drop(_RANK)


def first_with_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, total: str, parts: Sequence[str] = (), also: Column | None = None
) -> DataFrame:
    """The first ``n`` rows of every key, and those that ``also`` names, plus the number of rows the key had before cutting.

    Rows are ranked and counted within (key, part) first; only the first ``n`` of each part and its count go on to the key.
    ``parts`` names columns that split a key evenly, by which ``df`` may be dealt already; without it rows are dealt by a hash
    of all of them. Rows are read once and nothing is stored, and a key that owns a large share of them is ``PARTS`` groups.
    """
    if not parts:
        parts = ["__part"]
        df = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
    more = F.lit(False) if also is None else F.coalesce(also, F.lit(False))
    part, whole = Window.partitionBy(*keys, *parts), Window.partitionBy(*keys)
    first = (
        df.withColumn("__n", F.count(F.lit(1)).over(part))
        .withColumn(_RANK, F.row_number().over(part.orderBy(*order)))
        .filter((F.col(_RANK) <= n) | more)
    )
    counted = first.withColumn(total, F.sum(F.when(F.col(_RANK) == 1, F.col("__n"))).over(whole))
    placed = counted.withColumn(_RANK, F.row_number().over(whole.orderBy(*order)))
    return placed.filter((F.col(_RANK) <= n) | more).drop(_RANK, "__n", "__part")


def page_with_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, skip: int, total: str, parts: Sequence[str] = ()
) -> DataFrame:
    """A page per key plus the number of rows the key had before cutting, in one pass over the rows."""
    return page(first_with_total(df, keys, order, skip + n, total, parts), keys, order, n, skip)
