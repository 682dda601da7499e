"""Recommendation relations, for all users (or requests) at once.

Filters such as one user are left to the caller: a filter on the input DataFrames is pushed down.
``n`` means "per key"; ``None`` keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.core.catalog import Catalog
from mealgrid.core.clock import elapsed_days
from mealgrid.core.nesting import add_page, nested
from mealgrid.core.ranking import first_with_total, page, ranked, top_n
from mealgrid.core.scratch import written
from mealgrid.operators.filters import (
    is_unexpired,
    primary_only,
    purchasable,
    recipe_card,
    stale_purchases,
    unexpired,
    with_ratio_at_least,
)
from mealgrid.operators.hierarchy import (
    held_ingredients,
    product_ingredients_with_parent,
    with_ancestors,
)
from mealgrid.plans.coverage import coverage, measured_lines, ratio, required_lines

RECIPE_CARD = ["recipe_id", "name", "image_url", "difficulty", "prep_time_min", "cook_time_min", "servings",
               "cooking_method"]


def owned_by_user(catalog: Catalog, as_of, closure: DataFrame | None = None) -> DataFrame:
    """(user_id, ingredient_id): the shared definition of owning."""
    return held_ingredients(
        catalog.user_fridge, catalog.product_ingredient, catalog.ingredient, as_of, closure
    )


def fridge_recipe_match(catalog: Catalog, as_of, min_coverage: float = 0.0, n: int | None = None) -> DataFrame:
    """(user, recipe) by share of required ingredients already at home."""
    lines = measured_lines(required_lines(catalog), catalog.recipe.select("recipe_id", "cook_time_min"))
    rows = coverage(written(owned_by_user(catalog, as_of), "owned"), "user_id", lines).drop("part")
    rows = with_ratio_at_least(rows, "covered_count", "required_count", min_coverage).withColumn(
        "coverage", ratio("covered_count", "required_count")
    )
    order = [
        F.col("coverage").desc(),
        F.col("missing_count").asc(),
        F.col("cook_time_min").asc_nulls_last(),
        F.col("recipe_id").asc(),
    ]
    best = rows if n is None else top_n(rows, ["user_id"], order, n)
    return best.join(catalog.recipe.select("recipe_id", "name", "difficulty"), "recipe_id")


def recipe_priority(recipe_product: DataFrame) -> DataFrame:
    """Highest designated priority per recipe (keeps one row per recipe before joining)."""
    return recipe_product.groupBy("recipe_id").agg(
        F.max("recommendation_priority").alias("recommendation_priority")
    )


def promoted_lines(catalog: Catalog) -> DataFrame:
    """Required lines with what ranks their recipes for a user."""
    recipe = catalog.recipe.select("recipe_id", "cook_time_min").join(
        recipe_priority(catalog.recipe_product), "recipe_id", "left"
    )
    return measured_lines(required_lines(catalog), recipe)


def ranked_recipe_matches(
    catalog: Catalog, owned: DataFrame, lines: DataFrame, min_match_rate: float = 0.0, n: int | None = None
) -> DataFrame:
    """(user, recipe) counts and rate in promotion order, without names and ingredient lists.

    ``owned`` is the stored form of ``owned_by_user``, ``lines`` what ``promoted_lines`` gives.
    """
    rows = coverage(owned, "user_id", lines).drop("part")
    rows = (
        with_ratio_at_least(rows, "covered_count", "required_count", min_match_rate)
        .withColumn("match_rate", ratio("covered_count", "required_count"))
        .withColumnRenamed("covered_count", "available_count")
        .withColumn("recommendation_priority", F.coalesce("recommendation_priority", F.lit(0)))
    )
    if n is None:
        return rows
    return top_n(
        rows,
        ["user_id"],
        [
            F.col("recommendation_priority").desc(),
            F.col("match_rate").desc(),
            F.col("missing_count").asc(),
            F.col("cook_time_min").asc_nulls_last(),
            F.col("recipe_id").asc(),
        ],
        n,
    )


def my_recipe_candidates(catalog: Catalog, as_of, min_match_rate: float = 0.0, n: int | None = None) -> DataFrame:
    """Ranked matches with three disjoint ingredient lists: missing, held and pantry.

    The ranking runs first, on counts only, and is stored; lists are collected for its rows.
    A pantry staple is listed as pantry even when it is also in the fridge.
    """
    owned, required = written(owned_by_user(catalog, as_of), "owned"), promoted_lines(catalog)
    matches = written(ranked_recipe_matches(catalog, owned, required, min_match_rate, n), "matches")
    names = catalog.ingredient.select("ingredient_id", F.col("name").alias("ingredient_name"))
    order = {"name": F.col("ingredient_name"), "id": F.col("ingredient_id")}
    shown = required.select("recipe_id", "ingredient_id", "is_pantry").join(matches.select("recipe_id"), "recipe_id", "left_semi")
    lines = add_page(shown.join(names, "ingredient_id"), ["recipe_id"], order)
    held = owned.withColumn("in_fridge", F.lit(True))
    fields = {"ingredient_id": F.col("ingredient_id"), "name": F.col("ingredient_name")}
    staple, in_fridge = F.col("is_pantry"), F.col("in_fridge").isNotNull()
    lists = (
        matches.select("user_id", "recipe_id")
        .join(lines, "recipe_id")
        .join(held, ["user_id", "ingredient_id"], "left")
        .groupBy("user_id", "recipe_id", "page")
        .agg(
            nested(order, fields, ~staple & ~in_fridge).alias("missing_ingredients"),
            nested(order, fields, ~staple & in_fridge).alias("held_ingredients"),
            nested(order, fields, staple).alias("pantry_ingredients"),
        )
    )
    card = catalog.recipe.select("recipe_id", "name", "image_url", "difficulty", "servings")
    return matches.join(lists, ["user_id", "recipe_id"]).join(card, "recipe_id")


def line_status(
    catalog: Catalog, requests: DataFrame, as_of, closure: DataFrame | None = None
) -> DataFrame:
    """Status of every recipe line for each request (user_id, recipe_id, base_product_id).

    BASE: the chosen product fills it; IN_FRIDGE: the user has it; PANTRY: a staple; else MISSING.
    A NULL base product or user switches that branch off, because NULL joins nothing.
    """
    keys = ["user_id", "recipe_id", "base_product_id"]
    ingredient = catalog.ingredient.select("ingredient_id", F.col("name").alias("ingredient_name"), "is_pantry")
    lines = catalog.recipe_ingredient.select("recipe_id", "ingredient_id", "quantity", "unit", "is_required")
    if closure is None:
        filled = product_ingredients_with_parent(catalog.product_ingredient, catalog.ingredient)
    else:
        filled = with_ancestors(primary_only(catalog.product_ingredient), closure, "product_id")
    base = filled.select(
        F.col("product_id").alias("base_product_id"), "ingredient_id", F.lit(True).alias("in_base")
    )
    # only holdings of users who ask
    fridge = catalog.user_fridge.join(requests.select("user_id"), "user_id", "left_semi")
    held = held_ingredients(fridge, catalog.product_ingredient, catalog.ingredient, as_of, closure).withColumn("in_fridge", F.lit(True))
    status = (
        F.when(F.col("in_base"), "BASE")
        .when(F.col("in_fridge"), "IN_FRIDGE")
        .when(F.col("is_pantry"), "PANTRY")
        .otherwise("MISSING")
    )
    return (
        requests.select(*keys)
        .distinct()
        .join(lines.join(ingredient, "ingredient_id"), "recipe_id")
        .join(base, ["base_product_id", "ingredient_id"], "left")
        .join(held, ["user_id", "ingredient_id"], "left")
        .withColumn("status", status)
        .drop("in_base", "in_fridge")
    )


def recipe_missing_ingredients(catalog: Catalog, requests: DataFrame, as_of) -> DataFrame:
    """Every line of the requested recipes with its status and its place in the display order."""
    place = (
        F.when(F.col("status") == "MISSING", 1)
        .when(F.col("status") == "IN_FRIDGE", 2)
        .when(F.col("status") == "BASE", 3)
        .otherwise(4)
    )
    return line_status(catalog, requests, as_of).withColumn("status_order", place)


def latest_popularity(popularity: DataFrame) -> DataFrame:
    """Newest score per product (partial ``max_by``, no window)."""
    return popularity.groupBy("product_id").agg(
        F.max_by("popularity_score", F.struct("period_end", "popularity_score")).alias("popularity_score")
    )


def product_ranking(
    catalog: Catalog, places: DataFrame, n: int, by_popularity: bool
) -> DataFrame:
    """The best ``n`` purchasable products for each (recipe_id, ingredient_id) in ``places``.

    The ranking does not depend on the user. Products without a designation share one order per
    ingredient, so only the first ``n`` of that order can matter, and they are ranked once per
    ingredient. Designated products of a place are added and the union is ranked again. This is
    exact while priorities are not negative, which is checked.
    """
    product = purchasable(catalog.product).select("product_id", F.col("name").alias("product_name"), "price")
    offers = (
        primary_only(catalog.product_ingredient)
        .select("product_id", "ingredient_id")
        .join(product, "product_id")
        .join(latest_popularity(catalog.product_popularity), "product_id", "left")
        .withColumn("popularity_score", F.coalesce("popularity_score", F.lit(0.0)))
    )
    tail = [F.col("popularity_score").desc()] if by_popularity else []
    tail = [*tail, F.col("price").asc(), F.col("product_id").asc()]
    general = places.join(top_n(offers, ["ingredient_id"], tail, n), "ingredient_id").withColumn(
        "recommendation_priority", F.lit(0).cast("int")
    )
    priority = F.when(F.col("recommendation_priority") < 0, F.raise_error(F.lit("negative recommendation priority")))
    designated = (
        catalog.recipe_product.join(places, ["recipe_id", "ingredient_id"], "left_semi")
        .withColumn(
            "recommendation_priority", priority.otherwise(F.col("recommendation_priority")).cast("int")
        )
        .join(offers, ["product_id", "ingredient_id"])
        .select(*general.columns)
    )
    # a designated product also in the general list keeps its designated priority
    merged = general.unionByName(designated).groupBy("recipe_id", "ingredient_id", "product_id").agg(
        F.max("recommendation_priority").alias("recommendation_priority"),
        F.first("product_name").alias("product_name"),
        F.first("price").alias("price"),
        F.first("popularity_score").alias("popularity_score"),
    )
    return ranked(
        merged,
        ["recipe_id", "ingredient_id"],
        [F.col("recommendation_priority").desc(), *tail],
        n,
        "rank_in_ingredient",
    )


def _products_for(catalog: Catalog, missing: DataFrame, n: int, by_popularity: bool) -> DataFrame:
    places = missing.select("recipe_id", "ingredient_id").distinct()
    best = product_ranking(catalog, places, n, by_popularity)
    return missing.join(best, ["recipe_id", "ingredient_id"])


def missing_ingredient_products(catalog: Catalog, requests: DataFrame, as_of, n: int) -> DataFrame:
    """(user, recipe, ingredient, product): designated first, then popular, then cheap."""
    pairs = requests.select("user_id", "recipe_id").distinct()
    asked = pairs.withColumn("base_product_id", F.lit(None).cast("bigint"))
    missing = (
        line_status(catalog, asked, as_of)
        .filter("is_required AND status = 'MISSING'")
        .select("user_id", "recipe_id", "ingredient_id", "ingredient_name")
    )
    return _products_for(catalog, missing, n, by_popularity=True)


def missing_products(
    catalog: Catalog, requests: DataFrame, as_of, n: int, closure: DataFrame | None = None
) -> DataFrame:
    """(user, recipe, base product, ingredient, product), popularity shown but not ranked by.

    With ``closure`` the owning test follows all ancestors instead of the direct parent.
    """
    missing = (
        line_status(catalog, requests, as_of, closure)
        .filter("is_required AND status = 'MISSING'")
        .select("user_id", "recipe_id", "base_product_id", "ingredient_id", "ingredient_name")
    )
    return _products_for(catalog, missing, n, by_popularity=False)


def missing_products_nested(rows: DataFrame) -> DataFrame:
    """One row per missing ingredient with its ranked product array (at most ``n`` entries each)."""
    fields = {
        c: F.col(c)
        for c in ["product_id", "product_name", "price", "recommendation_priority", "popularity_score",
                  "rank_in_ingredient"]
    }
    return rows.groupBy("user_id", "recipe_id", "base_product_id", "ingredient_id", "ingredient_name").agg(
        nested({"rank": F.col("rank_in_ingredient")}, fields).alias("products")
    )


def reorder_candidates(catalog: Catalog, as_of, days: int, n: int | None = None) -> DataFrame:
    """(user, product) bought before but not lately and not fresh in the user's fridge."""
    product = purchasable(catalog.product).select(
        "product_id", F.col("name").alias("product_name"), "price", "storage_type"
    )
    fresh = unexpired(catalog.user_fridge, as_of).select("user_id", "product_id")
    rows = (
        stale_purchases(catalog.user_product_affinity, as_of, days)
        .join(product, "product_id")
        .join(fresh, ["user_id", "product_id"], "left_anti")
        .withColumn("days_elapsed", elapsed_days(as_of, F.col("last_purchased_at")))
    )
    if n is None:
        return rows
    return top_n(
        rows,
        ["user_id"],
        [
            F.col("affinity_score").desc(),
            F.col("purchase_count").desc(),
            F.col("last_purchased_at").asc(),
            F.col("product_id").asc(),
        ],
        n,
    )


def owner_classes(owned: DataFrame, owner: str) -> DataFrame:
    """(owner, class_id): owners of the same ingredients share a class, named by the smallest of them.

    The set of an owner is read as one array, so this is for owners of few ingredients, such as products.
    """
    sets = owned.groupBy(owner).agg(F.array_sort(F.collect_set("ingredient_id")).alias("ingredients"))
    classes = sets.groupBy("ingredients").agg(F.min(owner).alias("class_id"))
    return sets.join(classes, "ingredients").select(owner, "class_id")


def product_recipes(catalog: Catalog, n: int, skip: int = 0) -> DataFrame:
    """(product, recipe) pages: recipes the product helps to cook, with counts and the total found.

    Products of the same ingredients cover the same recipes, so pairs are made per class of products. What differs is the
    designation: a product's page comes from the first ``skip + n`` of its class and from its own designated recipes, which is
    exact while priorities are not negative (checked).
    """
    owned = product_ingredients_with_parent(catalog.product_ingredient, catalog.ingredient)
    classes = written(owner_classes(owned, "product_id"), "classes")
    first = classes.where("product_id = class_id").select("product_id")
    held = written(owned.join(first, "product_id", "left_semi").withColumnRenamed("product_id", "class_id"), "owned")
    negative = F.raise_error(F.lit("negative recommendation priority"))
    value = F.when(F.col("recommendation_priority") < 0, negative).otherwise(F.col("recommendation_priority"))
    priority = catalog.recipe_product.groupBy("product_id", "recipe_id").agg(F.max(value.cast("int")).alias("recommendation_priority"))
    marked = priority.where("recommendation_priority > 0").join(classes, "product_id").select("class_id", "recipe_id").distinct()
    lines = measured_lines(required_lines(catalog), catalog.recipe.select("recipe_id", "cook_time_min"))
    rows = coverage(held, "class_id", lines, marked).withColumnsRenamed(
        {"required_count": "total_count", "covered_count": "matched_count"}
    )
    general = [F.col("missing_count").asc(), F.col("cook_time_min").asc_nulls_last(), F.col("recipe_id").asc()]
    few = first_with_total(rows, ["class_id"], general, skip + n, "total_recipes", ["part"], F.col("is_marked"))
    pairs = few.join(classes, "class_id").join(priority, ["product_id", "recipe_id"], "left")
    pairs = pairs.withColumn("recommendation_priority", F.coalesce("recommendation_priority", F.lit(0)))
    shown = page(pairs, ["product_id"], [F.col("recommendation_priority").desc(), *general], n, skip)
    card = catalog.recipe.select(*[c for c in RECIPE_CARD if c != "cook_time_min"])
    return shown.drop("class_id", "part", "is_marked").join(card, "recipe_id")


def my_fridge_items(catalog: Catalog, as_of) -> DataFrame:
    """(user, product) slots with the main ingredients and an expiry flag; expired slots are kept."""
    links = primary_only(catalog.product_ingredient).select("product_id", "ingredient_id")
    names = catalog.ingredient.select("ingredient_id", F.col("name").alias("ingredient_name"))
    order = {"name": F.col("ingredient_name"), "id": F.col("ingredient_id")}
    ingredients = (
        add_page(links.join(names, "ingredient_id"), ["product_id"], order)
        .groupBy("product_id", "page")
        .agg(
            nested(
                order,
                {"ingredient_id": F.col("ingredient_id"), "name": F.col("ingredient_name")},
            ).alias("ingredients")
        )
    )
    product = catalog.product.select(
        "product_id", F.col("name").alias("product_name"), "storage_type", "weight_g", "image_url"
    )
    return (
        catalog.user_fridge.join(product, "product_id")
        .join(ingredients, "product_id", "left")
        .withColumn("page", F.coalesce("page", F.lit(0)))
        .withColumn("is_expired", ~is_unexpired(as_of))
    )


def recent_recipes(catalog: Catalog, n: int) -> DataFrame:
    """Last viewed recipes per user, newest first."""
    cards = recipe_card(catalog.user_recipe_view.join(catalog.recipe, "recipe_id"), "user_id", "viewed_at")
    return top_n(cards, ["user_id"], [F.col("viewed_at").desc(), F.col("recipe_id").desc()], n)


def favorite_recipes(catalog: Catalog, n: int) -> DataFrame:
    """Favourite recipes per user, newest first."""
    marked = catalog.user_recipe_favorite.withColumnRenamed("created_at", "favorited_at")
    cards = recipe_card(marked.join(catalog.recipe, "recipe_id"), "user_id", "favorited_at")
    return top_n(cards, ["user_id"], [F.col("favorited_at").desc(), F.col("recipe_id").desc()], n)


def fridge_candidates(catalog: Catalog) -> DataFrame:
    """Active products with their first main ingredient."""
    active = catalog.product.filter("is_active").select("product_id")
    return (
        primary_only(catalog.product_ingredient)
        .groupBy("product_id")
        .agg(F.min("ingredient_id").alias("ingredient_id"))
        .join(active, "product_id", "left_semi")
    )
