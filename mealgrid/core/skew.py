"""Equi-joins that stay balanced when a few keys own much of the work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.core.scratch import durable

HOT_SHARE = 200  # a key is hot when it makes more than 1/HOT_SHARE of all pairs: fewer than HOT_SHARE keys
BLOCK_SHARE = 1_000  # a block of a hot key holds about 1/BLOCK_SHARE of all pairs


def hot_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], share: int = HOT_SHARE, block_share: int = BLOCK_SHARE
) -> DataFrame:
    """Keys that make more than ``1/share`` of the joined pairs, with the ``sides`` to cut them by.

    By counting, there are fewer than ``share`` such keys. The counts read only the key columns, are
    combined inside the tasks, and are stored once (a row per key).
    """
    counted = durable(
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).cast("double").alias("__l"))
        .join(right.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("__r")), list(keys))
        .select(*keys, (F.col("__l") * F.col("__r")).alias("__pairs"))
    )
    total = counted.agg(F.sum("__pairs").alias("total")).first().total or 0.0
    sides = F.ceil(F.sqrt(F.col("__pairs") * F.lit(block_share / max(total, 1.0)))).cast("int")
    return counted.filter(F.col("__pairs") * F.lit(share) > F.lit(total)).select(*keys, sides.alias("sides"))


def _split(df: DataFrame, hot: DataFrame, keys: Sequence[str], by: Sequence[str], own: str, copied: str) -> DataFrame:
    sides = F.coalesce(F.col("sides"), F.lit(1))
    return (
        df.join(hot, list(keys), "left")
        .withColumn(own, F.pmod(F.xxhash64(*by), sides).cast("int"))
        .withColumn(copied, F.explode(F.sequence(F.lit(0), sides - 1)))
        .drop("sides")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_by: Sequence[str],
    right_by: Sequence[str],
    share: int = HOT_SHARE,
    block_share: int = BLOCK_SHARE,
) -> DataFrame:
    """Inner many-to-many equi-join on ``keys``, balanced for keys with very many pairs.

    Without hot keys this is the plain join. The pairs of a hot key form a rectangle; it is cut into
    ``sides × sides`` blocks. A left row takes one block row (hash of ``left_by``) and is copied to
    all block columns, a right row the other way round, so every pair meets in exactly one block.
    Other keys are one block. Hashes of column values are stable, so a task run again after a lost
    executor makes the same split.
    """
    hot = hot_keys(left, right, keys, share, block_share)
    if hot.limit(1).count() == 0:
        return left.join(right, list(keys), "inner")
    few = F.broadcast(hot)  # fewer than ``share`` rows
    blocks_left = _split(left, few, keys, left_by, "__row", "__col")
    blocks_right = _split(right, few, keys, right_by, "__col", "__row")
    return blocks_left.join(blocks_right, [*keys, "__row", "__col"], "inner").drop("__row", "__col")
