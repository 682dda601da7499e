"""Mixing sources to target weights by systematic sampling.

The size of a document is its number of words. A source's target is its share, by weight, of all words, at most
``max_epochs`` times the words it has; what is cut off is shared again by weight among the rest until nobody is above.
Each document of a source has the same expected number of copies, target / words of the source. Documents of a source
are laid out in order of size class, their expected copies are summed up along that order, one offset drawn for the source
is added, and a document is emitted once for every integer its interval crosses.

The order by size class makes the words taken come near the target: neighbours in the order have nearly equal sizes, so
skipping one or the other matters little. Running sums never need a source in one task: the order is (size class, block,
id) with ``BLOCKS`` hashed blocks per class, positions are counted within a block, and only one row per block enters
the running sum over the blocks of a source.

Null and empty texts have size 0 and are never taken. Null sources form one source, ordered last. Rows that repeat an id
are documents of their own (equal rows get neighbouring positions in any order, so the multiset of results is fixed).
A corpus without words has targets of 0. Other columns are ignored by the plan; ``repeat`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mealgrid.core.numbering import global_row_number
from mealgrid.core.scratch import written
from mealgrid.core.sizes import broadcast_if_small
from mealgrid.llm.common import WORD

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in order, repeating
MAX_EPOCHS = 3
BLOCKS = 64


def _hash32(value: Column) -> Column:
    """32 bits of a digest, the same in any engine."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size) per row."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    Resharing what the caps cut off raises every other target by one common factor, so each round needs only two sums
    over the table of sources: words not yet given away and weights still in play. It ends when no target is above its
    cap; every round but the last caps a source.
    """
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    place = totals.where(F.col("source").isNotNull()).select("source")
    # rank by code point: few names per range, and only one row per range is summed up
    ranked = _ranked(place).unionByName(
        totals.where(F.col("source").isNull()).select(
            "source", F.lit(place.count()).cast("long").alias("rank")
        )
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(
        totals.join(ranked, totals["source"].eqNullSafe(ranked["source"]))
        .select(totals["source"], "source_size", weight.alias("weight"))
        .withColumn("cap", F.col("source_size") * float(max_epochs)),
        "mix-weights",
    )
    level, left, mass = F.lit(0.0), 0.0, 1.0
    sums = table.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    words = sums[0] or 0.0
    if words:
        left, mass = words, sums[1]
        while True:
            above = F.col("weight") * F.lit(left) / F.lit(mass) > F.col("cap")
            now = table.agg(
                F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
            ).first()
            if words - now[0] == left or now[1] == mass or not now[1]:
                break
            left, mass = words - now[0], now[1]
        level = F.col("weight") * F.lit(left) / F.lit(mass)
    target = F.least(level, F.col("cap"))
    return table.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def _ranked(names: DataFrame) -> DataFrame:
    """(source, rank) with ranks from 0 by code point."""
    return global_row_number(names, [F.col("source")], "rank").select("source", (F.col("rank") - 1).alias("rank"))


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """(id, source, size, source_size, target, copies) per row of ``docs``."""
    sized = written(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    targets = source_targets(sized, weights, max_epochs)
    bits = F.bin("size")
    placed = (
        sized.withColumn("e", F.length(bits))
        .withColumn("m", F.substring(bits, 2, 3))
        .withColumn("block", _hash32(F.col("id").cast("string")) % BLOCKS)
    )
    group = ["source", "e", "m", "block"]
    counts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("e", "m", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(
        targets, counts["source"].eqNullSafe(targets["source"])
    ).select(*[counts[c] for c in group], "start", "source_size", "target", "rate")
    within = Window.partitionBy(*group).orderBy("id", "size")
    rows = placed.withColumn("nth", F.row_number().over(within))
    same = [rows[c].eqNullSafe(starts[c]) for c in group]
    joined = rows.join(starts, [*same[1:], same[0]]).select(
        "id", rows["source"], "size", "source_size", "target", "rate", (F.col("start") + F.col("nth")).alias("at")
    )
    offset = _hash32(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("")))) / F.lit(float(2**32))
    crossed = F.floor(F.col("rate") * F.col("at") + offset) - F.floor(F.col("rate") * (F.col("at") - 1) + offset)
    copies = F.when(F.col("size") > 0, F.least(crossed, F.lit(int(max_epochs)))).otherwise(0).cast("long")
    return joined.select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def report(planned: DataFrame) -> DataFrame:
    """The plan per document, in words."""
    return planned.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix: every document as often as its plan says, with all its columns.

    Ids that repeat share the copies of their rows: each of k rows with one id, source and size gets its own number of
    copies in some fixed order.
    """
    planned = plan(docs, id_col, text_col, source_col, **options)
    lists = planned.groupBy("id", "source", "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("__copies"))
    lists = lists.where(F.get("__copies", F.lit(0)) > 0)
    lists = broadcast_if_small(written(lists, "mix-copies"))  # else the texts are shuffled to it
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(
        F.struct("*").alias("__doc"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), size.alias("__size")
    )
    joined = sized.join(
        lists,
        sized["__id"].eqNullSafe(lists["id"])
        & sized["__source"].eqNullSafe(lists["source"])
        & (sized["__size"] == lists["size"]),
    )
    # rows alike in (id, source, size) are told apart by a number; there are few, and only they are sorted
    nth = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64("__doc")))
    one = joined.where(F.size("__copies") == 1).select("__doc", F.get("__copies", F.lit(0)).alias("__times"))
    several = joined.where(F.size("__copies") > 1).withColumn("__n", nth)
    several = several.select("__doc", F.coalesce(F.get("__copies", F.col("__n") - 1), F.lit(0)).alias("__times"))
    times = F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))
    return one.unionByName(several).select("__doc", times).select("__doc.*")
