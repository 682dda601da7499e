"""Rule-driven recipe groups ("bubbles").

A bubble is a data row: a rule type and its thresholds. Every measure a rule can ask about belongs
to the recipe alone, so measures are computed once per recipe and the rules are tested against
them; no aggregate is repeated per (bubble, recipe) pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.core.catalog import Catalog
from mealgrid.core.nesting import add_page, nested
from mealgrid.core.ranking import page_with_total, top_n
from mealgrid.core.scratch import durable
from mealgrid.functions import fixed_values as fixed
from mealgrid.operators.filters import primary_only

RULES_PER_BLOCK = 500

CANDIDATE_COLUMNS = ["recipe_id", "name", "image_url", "difficulty", "prep_time_min", "cook_time_min", "servings",
                     "cooking_method", "step_count", "ingredient_count"]


def category_counts(catalog: Catalog) -> DataFrame:
    """Per recipe: number of non-pantry lines and a map category name → lines.

    Two aggregations: (recipe, category) first, then one map entry per category, so a recipe with
    very many lines is already reduced when its map is built.
    """
    ingredient = catalog.ingredient.filter(~F.col("is_pantry")).select("ingredient_id", "ingredient_category_id")
    names = catalog.category.select(
        F.col("category_id").alias("ingredient_category_id"), F.col("name").alias("category_name")
    )
    per_category = (
        catalog.recipe_ingredient.select("recipe_id", "ingredient_id")
        .join(ingredient, "ingredient_id")
        .join(names, "ingredient_category_id", "left")
        .groupBy("recipe_id", "category_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = F.when(F.col("category_name").isNotNull(), F.struct("category_name", "n"))
    return per_category.groupBy("recipe_id").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(named)).alias("by_category")
    )


def step_counts(recipe_step: DataFrame) -> DataFrame:
    """Number of steps per recipe."""
    return recipe_step.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("steps"))


def recipe_measures(catalog: Catalog) -> DataFrame:
    """Every recipe with the measures the rules look at (NULL where a recipe has no lines or steps)."""
    return (
        catalog.recipe.select(*CANDIDATE_COLUMNS[:8])
        .join(category_counts(catalog), "recipe_id", "left")
        .join(step_counts(catalog.recipe_step), "recipe_id", "left")
    )


def parsed_rules(keyword: DataFrame) -> DataFrame:
    """Active bubbles with their rule fields as typed columns."""
    spec = F.col("rule_spec")
    return keyword.filter("is_active").select(
        "keyword_id",
        "rule_type",
        F.get_json_object(spec, "$.op").alias("op"),
        F.get_json_object(spec, "$.value").cast("double").alias("value"),
        F.coalesce(
            F.from_json(F.get_json_object(spec, "$.category_names"), "array<string>"),
            F.array().cast("array<string>"),
        ).alias("names"),
    )


def lines_in_categories(names: Column, by_category: Column) -> Column:
    """Sum of the map values under the wanted names."""
    per_name = F.transform(names, lambda n: F.coalesce(by_category[n], F.lit(0)))
    return F.aggregate(per_name, F.lit(0).cast("bigint"), lambda total, x: total + x)


def rule_holds(rule: Column) -> Column:
    """Whether the recipe of the row satisfies ``rule``; unknown rule types never hold."""
    kind, value = rule["rule_type"], rule["value"]
    total = F.col("total")
    within = F.coalesce(lines_in_categories(rule["names"], F.col("by_category")), F.lit(0))
    by_category = F.when(
        rule["op"] == fixed.OP_RATIO, (total > 0) & (within.cast("double") / total >= value)
    ).otherwise(within > 0)
    holds = (
        F.when(kind == fixed.RULE_INGREDIENT_COUNT, (total > 0) & (total <= value))
        .when(kind == fixed.RULE_STEP_COUNT, (F.col("steps") > 0) & (F.col("steps") <= value))
        .when(kind == fixed.RULE_CATEGORY, by_category)
        .when(kind == fixed.RULE_COOK_TIME, F.col("cook_time_min") <= value)
        .when(kind == fixed.RULE_SERVINGS, F.col("servings") <= value)
    )
    return F.coalesce(holds, F.lit(False))


def bubble_recipe_candidates_all(catalog: Catalog) -> DataFrame:
    """(keyword_id, recipe) for every active bubble and every recipe that satisfies its rule.

    Rules travel in blocks of about ``RULES_PER_BLOCK``; a recipe row meets each block once by an
    equi-join on the block number and unfolds only the rules it satisfies, so pairs that fail are
    never produced. The usual case is one block.
    """
    rules = parsed_rules(catalog.bubble_keyword)
    blocks = rules.select(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(RULES_PER_BLOCK)), F.lit(1))).scalar()
    in_blocks = rules.groupBy(F.pmod(F.xxhash64("keyword_id"), blocks).alias("block")).agg(
        F.collect_list(F.struct("keyword_id", "rule_type", "op", "value", "names")).alias("rules")
    )
    matching = F.filter("rules", rule_holds)
    return (
        recipe_measures(catalog)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - F.lit(1))))
        .join(in_blocks, "block")
        .withColumn("rule", F.explode(matching))
        .select(
            F.col("rule.keyword_id").alias("keyword_id"),
            *CANDIDATE_COLUMNS[:8],
            F.coalesce("steps", F.lit(0)).alias("step_count"),
            F.coalesce("total", F.lit(0)).alias("ingredient_count"),
        )
    )


def bubble_candidate_counts(catalog: Catalog) -> DataFrame:
    """Active bubbles with their number of candidates (zero included) and whether they may be shown."""
    counts = bubble_recipe_candidates_all(catalog).groupBy("keyword_id").agg(F.count(F.lit(1)).alias("candidates"))
    return (
        catalog.bubble_keyword.filter("is_active")
        .select("keyword_id", "label", "description", "min_candidates", "display_order")
        .join(counts, "keyword_id", "left")
        .withColumn("candidates", F.coalesce("candidates", F.lit(0)))
        .withColumn("is_servable", F.col("candidates") >= F.col("min_candidates"))
    )


def bubble_recipe_candidates(catalog: Catalog, n: int) -> DataFrame:
    """First ``n`` recipes of each bubble: few steps first, recipes without steps last."""
    steps = F.nullif(F.col("step_count"), F.lit(0))
    return top_n(
        bubble_recipe_candidates_all(catalog), ["keyword_id"], [steps.asc_nulls_last(), F.col("recipe_id").asc()], n
    )


def bubble_demand(catalog: Catalog) -> DataFrame:
    """(keyword, ingredient): how many recipes of the bubble need the ingredient (no pantry staples).

    (recipe, ingredient) is a key of the recipe lines, so counting rows counts recipes and the
    count can be pre-aggregated in every task.
    """
    ingredient = catalog.ingredient.filter(~F.col("is_pantry")).select("ingredient_id")
    needed = (
        catalog.recipe_ingredient.filter("is_required")
        .select("recipe_id", "ingredient_id")
        .join(ingredient, "ingredient_id", "left_semi")
    )
    return (
        bubble_recipe_candidates_all(catalog)
        .select("keyword_id", "recipe_id")
        .join(needed, "recipe_id")
        .groupBy("keyword_id", "ingredient_id")
        .agg(F.count(F.lit(1)).alias("recipe_count"))
    )


def bubble_products(catalog: Catalog, n: int, skip: int = 0) -> DataFrame:
    """Product page per bubble: active products of the ingredients its recipes need.

    Ranking uses the maximum demand only; the nested ingredient lists are built afterwards, for the
    products of the page.
    """
    demand = durable(bubble_demand(catalog))  # a row per bubble and ingredient, read twice below
    names = catalog.ingredient.select("ingredient_id", F.col("name").alias("ingredient_name"))
    links = primary_only(catalog.product_ingredient).select("product_id", "ingredient_id")
    product = catalog.product.filter("is_active").select(
        "product_id", "name", "price", "weight_g", "product_type", "storage_type", "origin_country", "stock_quantity"
    )
    offered = demand.join(links, "ingredient_id")
    best = (
        offered.groupBy("keyword_id", "product_id")
        .agg(F.max("recipe_count").alias("recipe_count"))
        .join(product, "product_id")
    )
    order = [F.col("recipe_count").desc(), F.col("price").asc(), F.col("product_id").asc()]
    shown = durable(page_with_total(best, ["keyword_id"], order, n, skip, "total_count"))  # one page per bubble
    demand = {"demand": -F.col("recipe_count"), "name": F.col("ingredient_name"), "id": F.col("ingredient_id")}
    entries = add_page(
        offered.join(shown.select("keyword_id", "product_id"), ["keyword_id", "product_id"], "left_semi").join(
            names, "ingredient_id"
        ),
        ["keyword_id", "product_id"],
        demand,
    )
    nested_names = entries.groupBy("keyword_id", "product_id", "page").agg(
        nested(
            demand,
            {"ingredient_id": F.col("ingredient_id"), "name": F.col("ingredient_name")},
        ).alias("ingredients")
    )
    return shown.join(nested_names, ["keyword_id", "product_id"])
