"""How much of a recipe an owner (a user or a product) already covers.

Both "what can this user cook" and "what can be cooked from this product" are the same relation
over (owner, ingredient) rows, so they share this plan:

* per recipe, once: number of required lines and how many of them are pantry staples, attached to its lines together with
  what ranks the recipe;
* per (owner, recipe): number of required lines the owner holds, from one equi-join on ingredient.

Covered lines are then a sum of the two, and neither the lines nor the recipes are joined to the candidate pairs again. Pairs
are shuffled once, dealt by owner and a part of the recipes, so an owner of very many pairs is ``PARTS`` groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mealgrid.core.catalog import Catalog
from mealgrid.core.scratch import written
from mealgrid.core.skew import salted_join

PARTS = 64  # parts of the recipes that one owner's pairs are dealt to
PART = "part"


def required_lines(catalog: Catalog) -> DataFrame:
    """(recipe_id, ingredient_id, is_pantry) of required recipe lines."""
    staples = catalog.ingredient.select("ingredient_id", "is_pantry")
    return (
        catalog.recipe_ingredient.filter("is_required")
        .select("recipe_id", "ingredient_id")
        .join(staples, "ingredient_id")
    )


def recipe_totals(lines: DataFrame) -> DataFrame:
    """Required and pantry line counts per recipe."""
    return lines.groupBy("recipe_id").agg(
        F.count(F.lit(1)).alias("required_count"), F.count_if("is_pantry").alias("pantry_count")
    )


def measured_lines(lines: DataFrame, recipe: DataFrame) -> DataFrame:
    """Required lines with the counts of their recipe and the columns of ``recipe``, stored: the joins below read them twice.

    The lines are computed once and counted by a window, whose order by recipe also serves the join.
    """
    own = Window.partitionBy("recipe_id")
    counted = lines.withColumn("required_count", F.count(F.lit(1)).over(own)).withColumn(
        "pantry_count", F.count(F.when(F.col("is_pantry"), 1)).over(own)
    )
    return written(counted.join(recipe, "recipe_id"), "measured-lines")


def part_of(recipe_id: str = "recipe_id") -> Column:
    """Part of the recipes."""
    return F.pmod(F.xxhash64(recipe_id), F.lit(PARTS)).cast("int")


def coverage(owned: DataFrame, owner: str, lines: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(owner, part, recipe) with at least one held required ingredient, with counts and what the lines carry of the recipe.

    ``owned`` is read several times, so the callers store it first; ``lines`` are ``measured_lines``. With ``marked``,
    some (owner, recipe), the pairs found have a column ``is_marked``.
    """
    about = [c for c in lines.columns if c not in ("recipe_id", "ingredient_id", "is_pantry")]
    hits = salted_join(owned, lines, ["ingredient_id"], [owner], ["recipe_id"])
    if marked is None:
        return _counted(hits.withColumn(PART, part_of()).repartition(owner, PART), owner, about)
    # marks travel as rows of their own and meet the hits in the aggregation
    both = hits.withColumn("is_marked", F.lit(False)).unionByName(
        marked.select(owner, "recipe_id", F.lit(True).alias("is_marked")), allowMissingColumns=True
    )
    pairs = _counted(both.withColumn(PART, part_of()).repartition(owner, PART), owner, about, F.max("is_marked").alias("is_marked"))
    return pairs.where("required_count IS NOT NULL")


def _counted(hits: DataFrame, owner: str, about: list[str], *more: Column) -> DataFrame:
    pairs = hits.groupBy(owner, PART, "recipe_id").agg(
        F.count_if(~F.col("is_pantry")).alias("held_count"), *[F.max(c).alias(c) for c in about], *more
    )
    covered = F.col("held_count") + F.col("pantry_count")
    return (
        pairs.withColumn("covered_count", covered)
        .withColumn("missing_count", F.col("required_count") - F.col("covered_count"))
        .drop("held_count", "pantry_count")
    )


def coverage_at_least(owned: DataFrame, owner: str, lines: DataFrame, least: float) -> DataFrame:
    """The pairs of :func:`coverage` that cover a share of at least ``least`` of the required lines, rare ingredients first.

    Whoever holds ``need`` of a recipe's lines holds one of any ``lines - need + 1`` of them, so pairs are found through the
    rarest that many, and the other lines, which hold the ingredients that nearly everyone has, are looked up for the pairs
    found. Worth it where a few common ingredients make most of the pairs and ``least`` asks for several lines; the result is
    the same.
    """
    about = [c for c in lines.columns if c not in ("recipe_id", "ingredient_id", "is_pantry")]
    owners = owned.groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("owners"))
    need = F.ceil(F.col("required_count") * F.lit(str(least)).cast("decimal(10,6)")).cast("long") - F.col("pantry_count")
    rare = Window.partitionBy("recipe_id").orderBy("is_pantry", F.coalesce("owners", F.lit(0)), "ingredient_id")
    placed = (
        lines.join(owners, "ingredient_id", "left")
        .withColumn("need", need)
        .withColumn("place", F.row_number().over(rare))
        .withColumn("early", (F.col("need") < 2) | (F.col("place") <= F.col("required_count") - F.col("pantry_count") - F.col("need") + 1))
        .drop("owners", "place")
    )
    placed = written(placed, "placed-lines")
    # staples make a pair only where they alone are enough
    first = placed.where("early AND (NOT is_pantry OR need < 1)")
    found = salted_join(owned, first, ["ingredient_id"], [owner], ["recipe_id"]).select(owner, "recipe_id", "ingredient_id", "is_pantry", "need", *about)
    found = written(found, "early-pairs")
    later = placed.where("NOT early AND NOT is_pantry").select("recipe_id", "ingredient_id")
    pairs = found.where("need > 1").select(owner, "recipe_id", *about).dropDuplicates([owner, "recipe_id"])
    looked_up = pairs.join(later, "recipe_id").join(owned, [owner, "ingredient_id"], "left_semi").withColumn("is_pantry", F.lit(False))
    hits = found.drop("need").unionByName(looked_up.select(owner, "recipe_id", "ingredient_id", "is_pantry", *about))
    rows = _counted(hits.withColumn(PART, part_of()).repartition(owner, PART), owner, about)
    return rows.where(F.col("covered_count") >= F.col("required_count") * F.lit(str(least)).cast("decimal(10,6)"))


def ratio(part: str, whole: str, places: int = 3):
    """Decimal share rounded half up."""
    exact = F.col(part).cast("decimal(18,0)") / F.col(whole).cast("decimal(18,0)")
    return F.round(exact, places)
