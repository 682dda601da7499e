"""Detail views: a product or a recipe with its nested lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.core.catalog import Catalog
from mealgrid.core.nesting import add_page, nested


def _empty_if_null(df: DataFrame, column: str) -> DataFrame:
    empty = F.array().cast(df.schema[column].dataType)
    return df.withColumn(column, F.coalesce(F.col(column), empty))


def product_lines(catalog: Catalog) -> DataFrame:
    """(product, ingredient) with name and role: the flat form of the product detail."""
    names = catalog.ingredient.select("ingredient_id", F.col("name").alias("ingredient_name"))
    return catalog.product_ingredient.select("product_id", "ingredient_id", "role").join(names, "ingredient_id")


def product_detail(catalog: Catalog) -> DataFrame:
    """Products with category name and nested ingredients (by role, then name); empty array when none."""
    order = {"role": F.col("role"), "name": F.col("ingredient_name"), "id": F.col("ingredient_id")}
    lists = (
        add_page(product_lines(catalog), ["product_id"], order)
        .groupBy("product_id", "page")
        .agg(
            nested(
                order,
                {"ingredient_id": F.col("ingredient_id"), "name": F.col("ingredient_name"), "role": F.col("role")},
            ).alias("ingredients")
        )
    )
    category = catalog.category.select("category_id", F.col("name").alias("category_name"))
    rows = (
        catalog.product.select(
            "product_id", "name", "price", "weight_g", "unit_count", "product_type", "storage_type",
            "origin_country", "stock_quantity", "is_active", "category_id",
        )
        .join(category, "category_id", "left")
        .drop("category_id")
        .join(lists, "product_id", "left")
        .withColumn("page", F.coalesce("page", F.lit(0)))
    )
    return _empty_if_null(rows, "ingredients")


def recipe_lines(catalog: Catalog) -> DataFrame:
    """(recipe, ingredient) with display fields: the flat form of the recipe's ingredient list."""
    ingredient = catalog.ingredient.select("ingredient_id", F.col("name").alias("ingredient_name"), "is_pantry")
    return catalog.recipe_ingredient.join(ingredient, "ingredient_id")


def recipe_detail(catalog: Catalog) -> DataFrame:
    """Recipes with nested lines (required first, then name) and nested steps in order.

    Lines and steps are aggregated on their own and joined by recipe and page; a recipe without
    lines or steps gets empty arrays.
    """
    line_fields = ["ingredient_id", "quantity", "unit", "is_required", "is_pantry", "purpose"]
    line_order = {"optional": ~F.col("is_required"), "name": F.col("ingredient_name"), "id": F.col("ingredient_id")}
    lines = (
        add_page(recipe_lines(catalog), ["recipe_id"], line_order)
        .groupBy("recipe_id", "page")
        .agg(
            nested(
                line_order,
                {"name": F.col("ingredient_name"), **{c: F.col(c) for c in line_fields}},
            ).alias("ingredients")
        )
    )
    steps = (
        add_page(catalog.recipe_step, ["recipe_id"], {"step_no": F.col("step_no")})
        .groupBy("recipe_id", "page")
        .agg(
            nested(
                {"step_no": F.col("step_no")},
                {c: F.col(c) for c in ["step_no", "instruction", "image_url"]},
            ).alias("steps")
        )
    )
    category = catalog.category.select("category_id", F.col("name").alias("category_name"))
    parts = lines.join(steps, ["recipe_id", "page"], "full")
    rows = (
        catalog.recipe.join(category, "category_id", "left")
        .drop("category_id")
        .join(parts, "recipe_id", "left")
        .withColumn("page", F.coalesce("page", F.lit(0)))
    )
    return _empty_if_null(_empty_if_null(rows, "ingredients"), "steps")
