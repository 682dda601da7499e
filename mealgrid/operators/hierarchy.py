"""Ingredient hierarchy: own + parent expansion and the transitive closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.core.scratch import durable
from mealgrid.operators.filters import primary_only, unexpired


def with_parent(rows: DataFrame, ingredient: DataFrame, *keys: str) -> DataFrame:
    """Distinct (keys, ingredient) for every ingredient and its direct parent."""
    parents = ingredient.select("ingredient_id", "parent_ingredient_id")
    both = F.explode(F.array("ingredient_id", "parent_ingredient_id"))
    return (
        rows.select(*keys, "ingredient_id")
        .join(parents, "ingredient_id", "left")
        .select(*keys, both.alias("ingredient_id"))
        .filter(F.col("ingredient_id").isNotNull())
        .distinct()
    )


def ancestors(ingredient: DataFrame) -> DataFrame:
    """Reflexive transitive closure (ingredient_id, ancestor_id) over the parent links.

    Path doubling: each round joins the pairs found so far with themselves, so a chain of depth d
    closes in about log2(d) rounds, however deep it is. Pairs are kept distinct, so a cycle ends when
    nothing new appears. The pair table is stored each round, which keeps the plan small and survives lost
    executors.
    """
    edges = ingredient.filter(F.col("parent_ingredient_id").isNotNull()).select(
        "ingredient_id", F.col("parent_ingredient_id").alias("ancestor_id")
    )
    selves = ingredient.select("ingredient_id", F.col("ingredient_id").alias("ancestor_id"))
    closure = durable(selves.unionByName(edges).distinct())
    size = closure.count()
    while True:
        upper = closure.select(
            F.col("ingredient_id").alias("ancestor_id"), F.col("ancestor_id").alias("next_id")
        )
        closure = durable(
            closure.join(upper, "ancestor_id").select("ingredient_id", F.col("next_id").alias("ancestor_id")).distinct()
        )
        grown = closure.count()
        if grown == size:
            return closure
        size = grown


def with_ancestors(rows: DataFrame, closure: DataFrame, *keys: str) -> DataFrame:
    """Distinct (keys, ingredient) for every ingredient and all its ancestors.

    An ingredient without a row in the closure stands for itself only.
    """
    return (
        rows.select(*keys, "ingredient_id")
        .join(closure, "ingredient_id", "left")
        .select(*keys, F.coalesce("ancestor_id", "ingredient_id").alias("ingredient_id"))
        .distinct()
    )


def product_ingredients_with_parent(links: DataFrame, ingredient: DataFrame) -> DataFrame:
    """(product_id, ingredient_id): the main ingredients of each product and their parents."""
    return with_parent(primary_only(links), ingredient, "product_id")


def held_ingredients(
    fridge: DataFrame, links: DataFrame, ingredient: DataFrame, as_of, closure: DataFrame | None = None
) -> DataFrame:
    """(user_id, ingredient_id) a user has: unexpired products → main ingredient → parent(s).

    The product side is expanded before meeting the fridge, so the hierarchy is joined once per
    product instead of once per fridge row. With ``closure`` all ancestors count, not just parents.
    """
    if closure is None:
        per_product = product_ingredients_with_parent(links, ingredient)
    else:
        per_product = with_ancestors(primary_only(links), closure, "product_id")
    return (
        unexpired(fridge, as_of)
        .select("user_id", "product_id")
        .join(per_product, "product_id")
        .select("user_id", "ingredient_id")
        .distinct()
    )
