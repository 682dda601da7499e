"""Table maintenance: staged rows → next versions of the catalog and activity tables.

Every load reduces its source to one row per key, then merges. A load that runs twice gives the
same table, except where quantities are added up on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.core.clock import moment
from mealgrid.core.merge import (
    increment,
    insert_only,
    keep_if_empty_json,
    keep_if_empty_list,
    keep_if_null,
    merge_aliases,
    merge_json,
    merge_table,
    overwrite,
    patch,
)
from mealgrid.core.numbering import global_row_number
from mealgrid.core.ranking import first_row, top_n
from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.text import nonempty
from mealgrid.operators.filters import primary_only

RECIPE_KEY = ["source_type", "source_recipe_id"]
PRODUCT_KEY = ["source_type", "source_product_id"]


def _cut(column: str, length: int) -> Column:
    return F.substring(F.col(column), 1, length).alias(column)


def upsert_recipes(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Names overwrite; other fields keep their value when the new one is missing or empty."""
    kept = ["description", "cuisine_type", "difficulty", "prep_time_min", "cook_time_min", "servings",
            "cooking_method", "image_url"]
    rules = {c: keep_if_null for c in kept if c in target.columns}
    rules |= {"name": overwrite}
    if "nutrition" in target.columns:
        rules["nutrition"] = keep_if_empty_json
    if "tags" in target.columns:
        rules["tags"] = keep_if_empty_list
    return merge_table(target, staged, RECIPE_KEY, rules)


def one_line_per_ingredient(staged_lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Staged recipe lines with their ingredient id, one per (recipe, ingredient).

    A required line wins, then the lower line number.
    """
    linked = staged_lines.join(matches.select("normalized_name", "ingredient_id"), "normalized_name")
    return first_row(
        linked, ["source_type", "source_id", "ingredient_id"], [F.col("is_required").desc(), F.col("line_no").asc()]
    )


def upsert_recipe_ingredients(
    target: DataFrame, staged_lines: DataFrame, matches: DataFrame, recipe: DataFrame
) -> DataFrame:
    """Recipe lines: requirement overwrites, quantity, unit and purpose keep their value when missing."""
    ids = recipe.select("source_type", F.col("source_recipe_id").alias("source_id"), "recipe_id")
    source = (
        one_line_per_ingredient(staged_lines, matches)
        .join(ids, ["source_type", "source_id"])
        .select("recipe_id", "ingredient_id", "quantity", _cut("unit", 30), "is_required", _cut("purpose", 50))
    )
    rules = {"quantity": keep_if_null, "unit": keep_if_null, "is_required": overwrite, "purpose": keep_if_null}
    return merge_table(target, source, ["recipe_id", "ingredient_id"], rules)


def replace_steps(target: DataFrame, incoming: DataFrame, staged_steps: DataFrame) -> DataFrame:
    """Steps beyond the last incoming step of a loaded recipe go, the rest is upserted.

    ``incoming`` lists the loaded recipe ids; one without staged steps loses all its steps.
    """
    last = (
        incoming.select("recipe_id")
        .distinct()
        .join(staged_steps.groupBy("recipe_id").agg(F.max("step_no").alias("max_step")), "recipe_id", "left")
        .withColumn("max_step", F.coalesce("max_step", F.lit(0)))
    )
    kept = (
        target.join(last, "recipe_id", "left")
        .filter(F.col("max_step").isNull() | (F.col("step_no") <= F.col("max_step")))
        .select(*target.columns)
    )
    rules = {"instruction": keep_if_null, "image_url": keep_if_null}
    return merge_table(kept, staged_steps, ["recipe_id", "step_no"], rules)


def insert_categories(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Add unknown category paths; ids continue in (depth, path) order and parents are found by path."""
    new = staged.join(target.select("path"), "path", "left_anti")
    highest = target.select(F.coalesce(F.max("category_id"), F.lit(0)).alias("m")).scalar()
    numbered = global_row_number(new, [F.col("depth"), F.col("path")], "row_no").withColumn(
        "category_id", F.col("row_no") + highest
    )
    known = target.select("path", "category_id").unionByName(numbered.select("path", "category_id"))
    parents = known.select(F.col("path").alias("parent_path"), F.col("category_id").alias("parent_id"))
    added = (
        numbered.join(parents, "parent_path", "left")
        .withColumn("name", F.substring("name", 1, 100))
        .select("category_id", "category_type", "parent_id", "name", "depth", "path")
    )
    return target.select(*added.columns).unionByName(added)


def upsert_products(target: DataFrame, staged: DataFrame, category: DataFrame) -> DataFrame:
    """Products by (source, cut natural id); missing values keep the old ones, metadata is merged."""
    paths = category.select(F.col("path").alias("category_path"), "category_id")
    source = staged.join(paths, "category_path", "left").select(
        _cut("source_type", 30),
        _cut("source_product_id", 100),
        nonempty(F.trim("sku")).alias("sku"),
        _cut("name", 255),
        "price",
        "category_id",
        _cut("product_type", 30),
        F.substring(nonempty(F.trim("brand_name")), 1, 100).alias("brand_name"),
        _cut("storage_type", 20),
        _cut("origin_country", 100),
        "weight_g",
        "unit_count",
        "stock_quantity",
        "metadata",
    )
    kept = ["category_id", "brand_name", "storage_type", "origin_country", "weight_g", "unit_count", "stock_quantity"]
    rules = {c: keep_if_null for c in kept}
    rules |= {"name": overwrite, "price": overwrite, "product_type": overwrite, "sku": insert_only,
              "metadata": merge_json}
    return merge_table(target, source, PRODUCT_KEY, {c: r for c, r in rules.items() if c in target.columns})


def one_link_per_ingredient(staged_links: DataFrame, matches: DataFrame, product: DataFrame) -> DataFrame:
    """Staged product links with ids, one per (product, ingredient): main role, then larger amounts."""
    by_name = matches.select("normalized_name", F.col("ingredient_id").alias("matched_id"))
    linked = (
        staged_links.join(by_name, "normalized_name", "left")
        .withColumn("ingredient_id", F.coalesce("ingredient_id", "matched_id"))
        .filter(F.col("ingredient_id").isNotNull())
        .join(product.select(*PRODUCT_KEY, "product_id"), PRODUCT_KEY)
    )
    order = [
        (F.col("role") == fixed.PRIMARY).desc(),
        F.col("quantity_g").desc_nulls_last(),
        F.col("ratio").desc_nulls_last(),
        F.col("normalized_name").asc(),
    ]
    return first_row(linked, ["product_id", "ingredient_id"], order).select(
        "product_id", "ingredient_id", "quantity_g", _cut("role", 30), "ratio"
    )


def upsert_product_ingredients(
    target: DataFrame, staged_links: DataFrame, matches: DataFrame, product: DataFrame
) -> DataFrame:
    """Product links: the role overwrites, amounts keep their value when missing."""
    source = one_link_per_ingredient(staged_links, matches, product)
    rules = {"quantity_g": keep_if_null, "role": overwrite, "ratio": keep_if_null}
    return merge_table(target, source, ["product_id", "ingredient_id"], rules)


def upsert_ingredient_master(target: DataFrame, staged: DataFrame, category: DataFrame) -> DataFrame:
    """Ingredients by identity key: names stay, pantry flag is authoritative, aliases are united.

    New rows get a NULL ingredient_id here; ids are numbered by the writer.
    """
    paths = category.filter(F.col("category_type") == "INGREDIENT").select(
        F.col("path").alias("category_path"), F.col("category_id").alias("ingredient_category_id")
    )
    source = staged.join(paths, "category_path", "left").select(
        "source_identity_key",
        _cut("name", 255),
        _cut("normalized_name", 255),
        "is_raw_material",
        "aliases",
        "is_pantry",
        "ingredient_category_id",
    )
    rules = {
        "name": insert_only,
        "normalized_name": insert_only,
        "is_raw_material": insert_only,
        "aliases": merge_aliases,
        "is_pantry": overwrite,
        "ingredient_category_id": keep_if_null,
    }
    return merge_table(target, source, ["source_identity_key"], rules)


def write_back_vectors(target: DataFrame, vectors: DataFrame, table: str, key: Column) -> DataFrame:
    """Embeddings of one table, found by its composed natural key; other rows keep their vector."""
    wanted = vectors.filter(F.col("target_table") == table).select(
        F.col("target_key").alias("__key"), F.col("embedding").alias("__vector")
    )
    return (
        target.withColumn("__key", key)
        .join(wanted, "__key", "left")
        .withColumn("embedding", F.coalesce("__vector", "embedding"))
        .drop("__key", "__vector")
    )


def empty_staging(staging: DataFrame) -> DataFrame:
    """A staging table without rows, for an overwrite."""
    return staging.filter(F.lit(False))


# ---------------------------------------------------------------- reviewed master changes


def alignment_plan(actions: DataFrame, ingredient: DataFrame) -> DataFrame:
    """INSERT / RENAME actions still to do, with ``problem`` where one cannot be done."""
    known = ingredient.select(
        "source_identity_key", F.col("name").alias("current_name"), F.lit(True).alias("exists")
    )
    parents = ingredient.select(
        F.col("source_identity_key").alias("parent_source_identity_key"), F.col("ingredient_id").alias("parent_id")
    )
    exists = F.col("exists").isNotNull()
    is_insert, is_rename = F.col("action") == "INSERT", F.col("action") == "RENAME"
    no_parent = nonempty(F.col("parent_source_identity_key")).isNotNull() & F.col("parent_id").isNull()
    problem = (
        F.when(~is_insert & ~is_rename, "unknown action")
        .when(is_insert & ~exists & no_parent, "parent missing")
        .when(is_rename & ~exists, "nothing to rename")
    )
    due = (is_insert & ~exists) | (is_rename & exists & (F.col("current_name") != F.col("name")))
    return (
        actions.join(known, "source_identity_key", "left")
        .join(parents, "parent_source_identity_key", "left")
        .withColumn("problem", problem)
        .filter(due | F.col("problem").isNotNull())
        .drop("exists")
    )


def align_master(ingredient: DataFrame, plan: DataFrame) -> DataFrame:
    """The master with a problem-free plan applied; applying it again changes nothing."""
    refused = F.when(
        F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("alignment refused: "), F.col("problem")))
    )
    source = plan.select(
        "source_identity_key",
        F.coalesce(refused, F.col("name")).alias("name"),
        F.col("name").alias("normalized_name"),
        "is_raw_material",
        F.filter(F.split("aliases", r"\|"), lambda a: a != "").alias("aliases"),
        F.col("parent_id").alias("parent_ingredient_id"),
    )
    rules = {
        "name": overwrite,
        "normalized_name": overwrite,
        "is_raw_material": insert_only,
        "aliases": insert_only,
        "parent_ingredient_id": insert_only,
    }
    return merge_table(ingredient, source, ["source_identity_key"], rules)


def parts_plan(parts: DataFrame, ingredient: DataFrame) -> DataFrame:
    """Child parts with ``outcome``: new, exists or orphan (parent not in the master)."""
    known = ingredient.select("source_identity_key", F.lit(True).alias("exists"))
    parents = ingredient.select(
        F.col("source_identity_key").alias("parent_key"), F.col("ingredient_id").alias("parent_ingredient_id")
    )
    outcome = (
        F.when(F.col("parent_ingredient_id").isNull(), "orphan").when(F.col("exists"), "exists").otherwise("new")
    )
    return (
        parts.join(known, "source_identity_key", "left")
        .join(parents, "parent_key", "left")
        .withColumn("outcome", outcome)
        .drop("exists")
    )


def alias_changes(ingredient: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Ingredients whose aliases differ from the reviewed list, with the new list and the removals.

    ``reviewed`` holds (source_identity_key, alias) rows; the lists are alias lists of one
    ingredient. Ingredients without reviewed aliases end up with none.
    """
    lists = reviewed.groupBy("source_identity_key").agg(F.array_sort(F.collect_set("alias")).alias("reviewed"))
    empty = F.array().cast("array<string>")
    return (
        ingredient.select("ingredient_id", "name", "source_identity_key", "aliases")
        .join(lists, "source_identity_key", "left")
        .withColumn("keep", F.coalesce("reviewed", empty))
        .withColumn("aliases", F.coalesce("aliases", empty))
        .filter(F.array_sort("aliases") != F.col("keep"))
        .withColumn("removed", F.array_sort(F.array_except("aliases", "keep")))
        .drop("reviewed")
    )


def reset_aliases(ingredient: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The master with reviewed alias lists."""
    source = alias_changes(ingredient, reviewed).select("source_identity_key", F.col("keep").alias("aliases"))
    return merge_table(ingredient, source, ["source_identity_key"], {"aliases": overwrite}, insert=False)


def load_guideline(
    target: DataFrame, accepted: DataFrame, processed: DataFrame, raw_ingredients: DataFrame
) -> DataFrame:
    """Guideline after pruning processed sources on raw materials and upserting accepted rows.

    ``action`` is inserted, updated, kept or pruned; pruned rows are only reported. A pruned key
    that is also accepted comes back as inserted.
    """
    key = ["ingredient_id", "storage_location", "storage_context"]
    listed = processed.select("source_food_name", F.coalesce("source_food_subtitle", F.lit("")).alias("__sub"))
    keyed = target.withColumn("__sub", F.coalesce("source_food_subtitle", F.lit("")))
    pruned = (
        keyed.join(raw_ingredients.select("ingredient_id").distinct(), "ingredient_id", "left_semi")
        .join(listed, ["source_food_name", "__sub"], "left_semi")
        .select(*target.columns)
    )
    left = target.join(pruned.select(*key), key, "left_anti").select(*target.columns)
    rules = {c: overwrite for c in target.columns if c not in key and c in accepted.columns}
    merged = merge_table(left, accepted, key, rules)
    return merged.unionByName(pruned.withColumn("action", F.lit("pruned")))


def guarded_stock_update(product: DataFrame, stock: DataFrame, source: str, reset: bool = False) -> DataFrame:
    """Stock where it is unknown or was written by the same source; the source is tagged in metadata."""
    tagged = stock.select("product_id", "stock_quantity").withColumn(
        "metadata", F.to_json(F.struct(F.lit(source).alias("stock_source")))
    )
    ours = F.get_json_object(F.col("t.metadata"), "$.stock_source") == source
    allowed = F.lit(reset) | F.col("t.stock_quantity").isNull() | F.coalesce(ours, F.lit(False))
    rules = {"stock_quantity": overwrite, "metadata": merge_json}
    return merge_table(product, tagged, ["product_id"], rules, update_when=allowed, insert=False)


# ---------------------------------------------------------------- fridge and activity

FRIDGE_KEY = ["user_id", "product_id"]


def add_to_fridge(fridge: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """Put products in the fridge, one row per main ingredient; existing slots stay untouched."""
    linked = items.join(primary_only(links).select("product_id", "ingredient_id"), "product_id")
    rules = {c: insert_only for c in ("quantity", "unit", "expires_at")}
    return merge_table(fridge, linked, ["ingredient_id", *FRIDGE_KEY], rules)


def patch_fridge(fridge: DataFrame, changes: DataFrame) -> DataFrame:
    """NULL leaves quantity and unit as they are; ``set_expiry`` lets NULL be a new expiry date."""
    rules = {"quantity": keep_if_null, "unit": keep_if_null, "expires_at": patch("set_expiry")}
    return merge_table(fridge, changes, FRIDGE_KEY, rules, insert=False)


def delivered_once(items: DataFrame) -> DataFrame:
    """One row per (user, product): quantities summed, unit and expiry of the last item."""
    last = F.max(F.struct("item_no", "unit", "expires_at", "set_expiry"))
    return (
        items.groupBy(*FRIDGE_KEY)
        .agg(F.sum("quantity").alias("quantity"), last.alias("last"))
        .select(*FRIDGE_KEY, "quantity", "last.unit", "last.expires_at", "last.set_expiry")
    )


def delivery_outcomes(
    fridge: DataFrame, items: DataFrame, product: DataFrame, links: DataFrame
) -> DataFrame:
    """Per delivered (user, product): inserted, updated, or skipped with a reason."""
    exists = product.select("product_id", F.lit(True).alias("known"))
    main = primary_only(links).select("product_id").distinct().withColumn("linked", F.lit(True))
    slots = fridge.select(*FRIDGE_KEY).distinct().withColumn("held", F.lit(True))
    action = (
        F.when(F.col("known").isNull(), "skipped")
        .when(F.col("held"), "updated")
        .when(F.col("linked").isNull(), "skipped")
        .otherwise("inserted")
    )
    reason = F.when(F.col("known").isNull(), "PRODUCT_NOT_FOUND").when(
        F.col("action") == "skipped", "NO_PRIMARY_INGREDIENT"
    )
    return (
        delivered_once(items)
        .join(exists, "product_id", "left")
        .join(main, "product_id", "left")
        .join(slots, FRIDGE_KEY, "left")
        .withColumn("action", action)
        .withColumn("reason", reason)
        .drop("known", "linked", "held")
    )


def add_deliveries(fridge: DataFrame, items: DataFrame, product: DataFrame, links: DataFrame) -> DataFrame:
    """Fridge after a delivery: quantities add up, the unit is replaced, expiry only where given."""
    accepted = delivery_outcomes(fridge, items, product, links).filter(F.col("action") != "skipped")
    rules = {"quantity": increment, "unit": overwrite, "expires_at": patch("set_expiry")}
    return merge_table(fridge, accepted.drop("action", "reason"), FRIDGE_KEY, rules)


def delete_keys(table: DataFrame, listed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table without the listed keys, the deleted rows)."""
    wanted = listed.select(*keys).distinct()
    return table.join(wanted, keys, "left_anti"), table.join(wanted, keys, "left_semi")


def add_favorites(favorites: DataFrame, added: DataFrame) -> DataFrame:
    """First add wins; repeated adds change nothing."""
    first = added.groupBy("user_id", "recipe_id").agg(F.min("created_at").alias("created_at"))
    return merge_table(favorites, first, ["user_id", "recipe_id"], {"created_at": insert_only})


def record_views(views: DataFrame, seen: DataFrame, keep: int) -> DataFrame:
    """One row per (user, recipe) with the latest time, the ``keep`` most recent per user."""
    latest = seen.groupBy("user_id", "recipe_id").agg(F.max("viewed_at").alias("viewed_at"))
    merged = merge_table(views, latest, ["user_id", "recipe_id"], {"viewed_at": lambda new, old: F.greatest(new, old)})
    return top_n(merged, ["user_id"], [F.col("viewed_at").desc(), F.col("recipe_id").desc()], keep)


def ensure_users(users: DataFrame, seen: DataFrame, as_of) -> DataFrame:
    """Unknown users are added with ``as_of`` as creation time."""
    new = seen.select("user_id").distinct().withColumn("created_at", moment(as_of))
    return merge_table(users, new, ["user_id"], {"created_at": insert_only})


def replace_user_sets(table: DataFrame, replacement: DataFrame) -> DataFrame:
    """All rows of the users named in ``replacement`` give way to its rows."""
    users = replacement.select("user_id").distinct()
    return table.join(users, "user_id", "left_anti").select(*replacement.columns).unionByName(replacement)


def upsert_priorities(recipe_product: DataFrame, priorities: DataFrame) -> DataFrame:
    """Designated product priorities."""
    return merge_table(
        recipe_product,
        priorities,
        ["recipe_id", "ingredient_id", "product_id"],
        {"recommendation_priority": overwrite},
    )


def link_parents(ingredient: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parent links of the configuration with ``outcome``: linked, already, parent missing, conflict.

    ``wanted`` has (ingredient_id, parent_name); a different existing parent is never overwritten.
    """
    parents = ingredient.groupBy(F.col("name").alias("parent_name")).agg(
        F.min("ingredient_id").alias("wanted_parent_id")
    )
    current = F.col("parent_ingredient_id")
    outcome = (
        F.when(F.col("wanted_parent_id").isNull(), "parent missing")
        .when(current == F.col("wanted_parent_id"), "already")
        .when(current.isNotNull(), "conflict")
        .otherwise("linked")
    )
    return (
        wanted.join(ingredient.select("ingredient_id", "parent_ingredient_id"), "ingredient_id")
        .join(parents, "parent_name", "left")
        .withColumn("outcome", outcome)
    )


def apply_parent_links(ingredient: DataFrame, links: DataFrame) -> DataFrame:
    """The master with the ``linked`` outcomes applied."""
    source = links.filter(F.col("outcome") == "linked").select(
        "ingredient_id", F.col("wanted_parent_id").alias("parent_ingredient_id")
    )
    return merge_table(ingredient, source, ["ingredient_id"], {"parent_ingredient_id": overwrite}, insert=False)


def make_available(product: DataFrame, chosen: DataFrame) -> DataFrame:
    """Reactivate chosen products; a sold-out stock becomes unknown, other stock stays."""
    flagged = chosen.select("product_id").distinct().withColumn("__chosen", F.lit(True))
    fix = F.col("__chosen").isNotNull() & (~F.col("is_active") | (F.col("stock_quantity") == 0))
    return (
        product.join(flagged, "product_id", "left")
        .withColumn("changed", F.coalesce(fix, F.lit(False)))
        .withColumn("stock_quantity", F.when(F.col("changed"), F.nullif("stock_quantity", F.lit(0))).otherwise(
            F.col("stock_quantity")))
        .withColumn("is_active", F.col("is_active") | F.col("changed"))
        .drop("__chosen")
    )


def before_image(table: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as they are now for every affected key; ``existed`` is false for keys to be created."""
    now = table.withColumn("existed", F.lit(True))
    return (
        affected.select(*keys)
        .distinct()
        .join(now, keys, "left")
        .withColumn("existed", F.coalesce("existed", F.lit(False)))
    )


def restore(table: DataFrame, image: DataFrame, keys: list[str]) -> DataFrame:
    """Undo: affected keys go back to their before-image."""
    untouched = table.join(image.select(*keys), keys, "left_anti").select(*table.columns)
    return untouched.unionByName(image.filter("existed").select(*table.columns))


def load_report(**tables: DataFrame) -> DataFrame:
    """One row per named table with its row count."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    report = counts[0]
    for count in counts[1:]:
        report = report.unionByName(count)
    return report


def as_utc(table: DataFrame) -> DataFrame:
    """Zone-free timestamp columns read as UTC instants."""
    naive = [f.name for f in table.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return table.withColumns({c: F.to_timestamp(F.concat(F.col(c).cast("string"), F.lit("+00:00"))) for c in naive})
