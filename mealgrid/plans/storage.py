"""Storage guidance: reviewed loading, representatives, and the lookup by product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.core.catalog import Catalog
from mealgrid.core.ranking import first_row
from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.storage import duration_days
from mealgrid.operators.filters import nonblank, primary_only

KEY = ["ingredient_id", "storage_location", "storage_context"]


def period_signature() -> Column:
    """What makes two periods equal: numbers and unit, or the trimmed text when all are missing."""
    no_period = F.col("duration_min").isNull() & F.col("duration_max").isNull() & F.col("duration_unit").isNull()
    return F.struct(
        "duration_min",
        "duration_max",
        "duration_unit",
        F.when(no_period, F.trim("duration_text")).alias("text"),
    )


def period_conflicts(ready: DataFrame) -> DataFrame:
    """Keys that carry more than one period signature.

    Signatures are made distinct first (map-side combined), then counted, so a key with very many
    rows is reduced to its few signatures before it is shuffled.
    """
    signatures = ready.select(*KEY, period_signature().alias("signature")).distinct()
    return (
        signatures.groupBy(*KEY).agg(F.count(F.lit(1)).alias("period_count")).filter(F.col("period_count") > 1)
    )


def marked_conflicts(staging: DataFrame, matches: DataFrame) -> DataFrame:
    """Staging rows with ingredient id and ``review_status`` = PERIOD_CONFLICT where a key conflicts."""
    ready = staging.join(matches.select("normalized_name", "ingredient_id"), "normalized_name")
    conflicts = period_conflicts(nonblank(ready, "duration_text"))
    detail = F.format_string("동일 조회 키에 서로 다른 기간 %d개", F.col("period_count"))
    return (
        ready.join(conflicts, KEY, "left")
        .withColumn("review_status", F.when(F.col("period_count").isNotNull(), "PERIOD_CONFLICT"))
        .withColumn("review_detail", F.when(F.col("period_count").isNotNull(), detail))
        .drop("period_count")
    )


def staged_representatives(marked: DataFrame) -> DataFrame:
    """One row per key without conflict: rows with a tip first, then by source item and slot."""
    ready = nonblank(marked, "duration_text").filter(F.col("review_status").isNull())
    no_tip = F.nullif(F.trim("storage_tips"), F.lit("")).isNull()
    return first_row(ready, KEY, [no_tip.asc(), F.col("source_item_id").asc(), F.col("source_slot").asc()])


def _origin() -> list[Column]:
    return [
        F.col("source_food_name").asc(),
        F.coalesce("source_food_subtitle", F.lit("")).asc(),
        F.col("source_slot").asc(),
    ]


def select_representatives(guideline: DataFrame) -> DataFrame:
    """One accepted row per key from reviewed guidance, with ``distinct_durations``.

    A key with one duration keeps the first row by origin; otherwise the shortest wins, rows without
    a duration come last, origin decides ties. When all durations are equal the length does not
    separate rows, so both cases are one ordering.
    """
    duration = F.struct("duration_min", "duration_max", "duration_unit")
    spread = (
        guideline.select(*KEY, duration.alias("duration"))
        .distinct()
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("distinct_durations"))
    )
    chosen = first_row(guideline, KEY, [duration_days().asc_nulls_last(), *_origin()])
    return chosen.join(spread, KEY)


def _source_label() -> Column:
    named = F.trim(F.concat_ws(" ", "source_food_name", F.coalesce("source_food_subtitle", F.lit(""))))
    return F.concat(named, F.lit(": "), F.col("duration_text"))


def representative_decisions(guideline: DataFrame) -> DataFrame:
    """(key, other source) rows: what was passed over for keys with differing durations.

    Labels are counted per key; the chosen row takes one off its own label, and every label still
    left belongs to another row.
    """
    chosen = select_representatives(guideline).filter(F.col("distinct_durations") > 1)
    subtitle = F.nullif(F.coalesce("source_food_subtitle", F.lit("")), F.lit(""))
    picked = chosen.select(
        *KEY,
        F.concat_ws(" / ", "source_food_name", subtitle).alias("chosen"),
        F.col("duration_text").alias("chosen_duration"),
        _source_label().alias("chosen_label"),
    )
    labels = guideline.groupBy(*KEY, _source_label().alias("other")).agg(F.count(F.lit(1)).alias("n"))
    left_over = F.col("n") - (F.col("other") == F.col("chosen_label")).cast("int")
    return (
        labels.join(picked, KEY).filter(left_over > 0).select(*KEY, "chosen", "chosen_duration", "other")
    )


def drop_processed_from_raw(guideline: DataFrame, processed: DataFrame, ingredient: DataFrame) -> DataFrame:
    """Remove guidance of processed sources, but only where the ingredient is a raw material."""
    raw = ingredient.filter("is_raw_material").select("ingredient_id")
    listed = processed.select(
        "source_food_name", F.coalesce("source_food_subtitle", F.lit("")).alias("subtitle")
    ).distinct()
    keyed = guideline.withColumn("subtitle", F.coalesce("source_food_subtitle", F.lit("")))
    on_raw = keyed.join(raw, "ingredient_id", "left_semi").join(listed, ["source_food_name", "subtitle"], "left_anti")
    not_raw = keyed.join(raw, "ingredient_id", "left_anti")
    return on_raw.unionByName(not_raw).drop("subtitle")


def apply_child_rules(guideline: DataFrame, rules: DataFrame, ingredient: DataFrame) -> DataFrame:
    """Move guidance of reviewed sources to the child ingredient; ``moved`` tells which rows changed."""
    children = ingredient.select(
        F.col("source_identity_key").alias("target_source_identity_key"), F.col("ingredient_id").alias("child_id")
    )
    targets = rules.join(children, "target_source_identity_key").select(
        "source_food_name", F.coalesce("source_food_subtitle", F.lit("")).alias("subtitle"), "child_id"
    )
    return (
        guideline.withColumn("subtitle", F.coalesce("source_food_subtitle", F.lit("")))
        .join(targets, ["source_food_name", "subtitle"], "left")
        .withColumn("moved", F.coalesce(F.col("child_id") != F.col("ingredient_id"), F.lit(False)))
        .withColumn("ingredient_id", F.coalesce("child_id", "ingredient_id"))
        .drop("child_id", "subtitle")
    )


def product_guideline_keys(catalog: Catalog) -> DataFrame:
    """Products with exactly one main ingredient and the ingredient whose guidance applies.

    The own ingredient is used when it has guidance in the product's place, otherwise its parent.
    """
    single = (
        primary_only(catalog.product_ingredient)
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ingredient_id").alias("ingredient_id"))
        .filter(F.col("n") == 1)
        .drop("n")
    )
    ingredient = catalog.ingredient.select(
        "ingredient_id", "parent_ingredient_id", F.col("name").alias("ingredient_name")
    )
    product = catalog.product.select("product_id", F.col("name").alias("product_name"), "storage_type")
    base = product.join(single, "product_id").join(ingredient, "ingredient_id")
    places = catalog.storage_guideline.select("ingredient_id", "storage_location").distinct()
    covered = places.groupBy("ingredient_id").agg(F.collect_set("storage_location").alias("own_places"))
    has_own = F.col("own_places").isNotNull() & (
        F.col("storage_type").isNull() | F.array_contains("own_places", F.col("storage_type"))
    )
    return (
        base.join(covered, "ingredient_id", "left")
        .withColumn(
            "guideline_ingredient_id",
            F.when(has_own, F.col("ingredient_id")).otherwise(F.coalesce("parent_ingredient_id", "ingredient_id")),
        )
        .drop("own_places", "parent_ingredient_id")
    )


def product_storage_guideline(catalog: Catalog) -> DataFrame:
    """(product, place, context): the shortest rule that applies to each product."""
    rules = catalog.storage_guideline.withColumnRenamed("ingredient_id", "guideline_ingredient_id")
    rows = (
        product_guideline_keys(catalog)
        .join(rules, "guideline_ingredient_id")
        .filter(F.col("storage_type").isNull() | (F.col("storage_location") == F.col("storage_type")))
    )
    shortest = F.coalesce(duration_days(), duration_days(unit=None))
    return first_row(
        rows,
        ["product_id", "storage_location", "storage_context"],
        [shortest.asc_nulls_last(), F.col("storage_tips").isNotNull().desc(), F.col("storage_id").asc()],
    )


def enum_violations(guideline: DataFrame) -> DataFrame:
    """Rows with a place, context or unit outside the allowed sets, one row per broken rule."""
    checks = [
        ("storage_location", ~F.col("storage_location").isin(*fixed.STORAGE_LOCATIONS)),
        ("storage_context", ~F.col("storage_context").isin(*fixed.STORAGE_CONTEXTS)),
        ("duration_unit", ~F.col("duration_unit").isin(*fixed.DURATION_UNIT_LABELS)),
        ("duration_order", F.col("duration_min") > F.col("duration_max")),
    ]
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in checks]))
    return guideline.withColumn("rule", F.explode(broken))


def most_guided_product(links: DataFrame, guideline: DataFrame) -> DataFrame:
    """(product_id, rules): the product whose main ingredients have most guidance rows, ties by id."""
    rules = guideline.groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n"))
    per_product = (
        primary_only(links).select("product_id", "ingredient_id").join(rules, "ingredient_id").groupBy("product_id")
    )
    return per_product.agg(F.sum("n").alias("rules")).orderBy(F.col("rules").desc(), F.col("product_id")).limit(1)
