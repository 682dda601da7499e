"""The tables the named relations read, passed around as one value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Catalog:
    """One DataFrame per table; keys in brackets.

    ingredient[ingredient_id], category[category_id], product[product_id],
    product_ingredient[product_id, ingredient_id], recipe[recipe_id],
    recipe_ingredient[recipe_id, ingredient_id], recipe_step[recipe_id, step_no],
    recipe_product[recipe_id, ingredient_id, product_id],
    storage_guideline[ingredient_id, storage_location, storage_context],
    user_fridge[user_id, product_id], user_product_affinity[user_id, product_id],
    product_popularity[product_id, period_end], bubble_keyword[keyword_id],
    user_recipe_favorite[user_id, recipe_id], user_recipe_view[user_id, recipe_id]
    """

    ingredient: DataFrame
    category: DataFrame
    product: DataFrame
    product_ingredient: DataFrame
    recipe: DataFrame
    recipe_ingredient: DataFrame
    recipe_step: DataFrame
    recipe_product: DataFrame
    storage_guideline: DataFrame
    user_fridge: DataFrame
    user_product_affinity: DataFrame
    product_popularity: DataFrame
    bubble_keyword: DataFrame
    user_recipe_favorite: DataFrame
    user_recipe_view: DataFrame
