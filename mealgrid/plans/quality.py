"""Data-quality checks: each returns rows that say what is wrong, and nothing when all is well."""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mealgrid.core.catalog import Catalog
from mealgrid.core.scratch import durable
from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.text import nonempty, stripped

# ---------------------------------------------------------------- datasets

SHORT_BYTES = 64
NO_SLOT = "no storage slot"
WHOLE_NUMBER = r"^-*\d+$"


def shared_columns(datasets: Mapping[str, DataFrame]) -> set[str]:
    """Names that columns of more than one dataset have."""
    seen = Counter(c for df in datasets.values() for c in df.columns)
    return {c for c, n in seen.items() if n > 1}


def _has_text(value: Column) -> Column:
    """More than white space; most values show it by their first character."""
    return ((value >= "!") & (value < "\x7f")) | nonempty(stripped(value)).isNotNull()


def _short(value: Column) -> Column:
    """Long values are told apart by their digest, which no value has itself; whole numbers stay as they are."""
    long = (F.octet_length(value) > SHORT_BYTES) & ~value.rlike(WHOLE_NUMBER)
    return F.when(long, F.concat(F.lit("sha256 "), F.sha2(value, 256))).otherwise(value)


def distinct_values(datasets: Mapping[str, DataFrame], columns: Collection[str] | None = None) -> DataFrame:
    """(dataset, column, value): distinct non-blank values of every column (or of those named ``columns``) of every dataset.

    Each dataset is unfolded and reduced on its own, with the reduction combined inside the tasks. Values of more than
    ``SHORT_BYTES`` bytes are given by a digest, whole numbers excepted.
    """
    result = None
    for name, df in datasets.items():
        wanted = [c for c in df.columns if columns is None or c in columns]
        if not wanted:
            continue
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in wanted])
        part = (
            df.select(F.explode(cells).alias("cell"))
            .select(F.lit(name).alias("dataset"), "cell.column", "cell.value")
            .filter(_has_text(F.col("value")))
            .withColumn("value", _short(F.col("value")))
            .distinct()
        )
        result = part if result is None else result.unionByName(part)
    if result is None:
        spark = next(iter(datasets.values())).sparkSession
        return spark.createDataFrame([], "dataset string, column string, value string")
    return result


#: Types whose values are neither blank nor a name when they are written as text.
_PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def slot_values(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, column, value): of every column the first storage slot that it holds, and ``NO_SLOT`` if it holds other values.

    These decide for ``slot_columns``. They are found in one pass over each dataset, without unfolding or dealing its rows.
    """
    names = [*fixed.STORAGE_SLOTS, NO_SLOT]

    def place(value: Column) -> Column:
        found = F.when(_has_text(value), len(names) - 1)
        for i, name in reversed([*enumerate(fixed.STORAGE_SLOTS)]):
            found = F.when(value == name, i).otherwise(found)
        return found

    result = None
    for name, df in datasets.items():
        texts, ends, cells = [], [], []
        for i, field in enumerate(df.schema):
            if isinstance(field.dataType, _PLAIN):
                texts.append(F.when(F.col(field.name).isNotNull(), len(names) - 1).alias(f"c{i}"))
            else:
                texts.append(place(F.col(field.name).cast("string")).alias(f"c{i}"))
            ends += [F.min(f"c{i}").alias(f"first{i}"), F.max(f"c{i}").alias(f"last{i}")]
            held = F.array_distinct(F.array(f"first{i}", f"last{i}"))
            cells.append(F.struct(F.lit(field.name).alias("column"), held.alias("held")))
        part = (
            df.select(*texts).agg(*ends).select(F.explode(F.array(*cells)).alias("cell"))
            .select(F.lit(name).alias("dataset"), "cell.column", F.explode("cell.held").alias("place"))
            .filter(F.col("place").isNotNull())
            .select("dataset", "column", F.get(F.array(*[F.lit(x) for x in names]), F.col("place")).alias("value"))
        )
        result = part if result is None else result.unionByName(part)
    return result


def duplicate_datasets(metadata: DataFrame) -> DataFrame:
    """Datasets (name, columns, row_count) that look like copies: same column names and row count.

    ``copy_group`` is the first name of the copies.
    """
    shaped = metadata.withColumn("shape", F.array_join(F.array_sort("columns"), ","))
    groups = (
        shaped.groupBy("shape", "row_count")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("name").alias("copy_group"))
        .filter(F.col("copies") > 1)
    )
    return shaped.join(groups, ["shape", "row_count"]).select("copy_group", "name")


def surrogate_columns(values: DataFrame) -> DataFrame:
    """(dataset, column, is_surrogate): whether all values are whole numbers."""
    return values.groupBy("dataset", "column").agg(
        F.bool_and(F.col("value").rlike(WHOLE_NUMBER)).alias("is_surrogate"), F.count(F.lit(1)).alias("n")
    )


def companion_datasets(values: DataFrame, metadata: DataFrame, share: float = fixed.OVERLAP_SHARE) -> DataFrame:
    """(left, right) datasets that hold parts of the same entities.

    Some shared column's values overlap by at least ``share`` of the smaller value set; columns of
    whole numbers prove nothing and copies are not companions. Values of ``shared_columns`` are enough. Every value is first reduced to the
    list of datasets holding it, equal lists are counted, and only those few lists unfold to pairs.
    """
    sizes = surrogate_columns(values).filter(~F.col("is_surrogate"))
    usable = values.join(sizes.select("dataset", "column"), ["dataset", "column"], "left_semi")
    holders = (
        usable.groupBy("column", "value")
        .agg(F.array_sort(F.collect_set("dataset")).alias("holders"))
        .filter(F.size("holders") > 1)
        .groupBy("column", "holders")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    pairs = (
        holders.withColumn("left", F.explode("holders"))
        .withColumn("right", F.explode("holders"))
        .filter(F.col("left") < F.col("right"))
        .groupBy("column", "left", "right")
        .agg(F.sum("shared").alias("shared"))
    )
    left = sizes.select(F.col("dataset").alias("left"), "column", F.col("n").alias("n_left"))
    right = sizes.select(F.col("dataset").alias("right"), "column", F.col("n").alias("n_right"))
    copies = duplicate_datasets(metadata)
    copy_left = copies.select(F.col("name").alias("left"), F.col("copy_group").alias("g_left"))
    copy_right = copies.select(F.col("name").alias("right"), F.col("copy_group").alias("g_right"))
    return (
        pairs.join(left, ["left", "column"])
        .join(right, ["right", "column"])
        .filter(F.col("shared") >= share * F.least("n_left", "n_right"))
        .join(copy_left, "left", "left")
        .join(copy_right, "right", "left")
        .filter(F.coalesce(F.col("g_left") != F.col("g_right"), F.lit(True)))
        .select("left", "right")
        .distinct()
    )


def slot_columns(values: DataFrame) -> DataFrame:
    """(dataset, column) whose values are all storage slots; the first such column per dataset.

    ``values`` are all distinct ones or ``slot_values``."""
    within = F.bool_and(F.col("value").isin(*fixed.STORAGE_SLOTS)).alias("within")
    return (
        values.groupBy("dataset", "column")
        .agg(within)
        .filter("within")
        .groupBy("dataset")
        .agg(F.min("column").alias("column"))
    )


def connected_groups(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(name, group): connected components of undirected ``edges`` (left, right) over ``members`` (name).

    The group is the smallest name. Every round takes the smallest label among neighbours and then
    jumps to that label's own label, so long chains shrink quickly; the labels are stored durably
    each round.
    """
    both = durable(
        edges.select("left", "right").unionByName(edges.select(F.col("right").alias("left"), F.col("left").alias("right")))
    )
    labels = durable(members.select("name", F.col("name").alias("group")).distinct())
    while True:
        heard = (
            both.join(labels, both["right"] == labels["name"])
            .groupBy(F.col("left").alias("name"))
            .agg(F.min("group").alias("heard"))
        )
        nearer = labels.join(heard, "name", "left").select(
            "name", F.col("group").alias("old"), F.least("group", F.coalesce("heard", "group")).alias("group")
        )
        jump = labels.select(F.col("name").alias("group"), F.col("group").alias("further"))
        moved = durable(
            nearer.join(jump, "group", "left").select(
                "name", "old", F.least("group", F.coalesce("further", "group")).alias("group")
            )
        )
        changed = moved.filter(F.col("old") != F.col("group")).limit(1).count()
        labels = moved.drop("old")
        if not changed:
            return labels


# ---------------------------------------------------------------- profiles

RECIPE_TABLES = ["recipe", "recipe_ingredient", "recipe_step"]
STORAGE_TABLE = "storage_guideline"


def _only(array: Column, allowed: Column) -> Column:
    return F.array_intersect(array, allowed)


def constrained_profiles(
    profiles: DataFrame, metadata: DataFrame, companions: DataFrame, slots: DataFrame
) -> DataFrame:
    """Dataset profiles corrected by what was measured, with the ``rules`` that changed each.

    ``profiles``: dataset, loadable, rows_per_entity, target_tables, group_by_columns,
    entity_key_columns, targets_recipe. One row per dataset throughout.
    """
    both = companions.select(F.col("left").alias("dataset"), F.col("right").alias("other")).unionByName(
        companions.select(F.col("right").alias("dataset"), F.col("left").alias("other"))
    )
    no_names = F.array().cast("array<string>")
    columns = metadata.select(F.col("name").alias("dataset"), "columns")
    measured = both.groupBy("dataset").agg(F.array_sort(F.collect_set("other")).alias("measured_companions"))
    rows = (
        profiles.join(columns, "dataset")
        .join(measured, "dataset", "left")
        .join(slots.select("dataset", F.col("column").alias("slot_column")), "dataset", "left")
        .withColumn("rules", no_names)
        .withColumn("companion_datasets", F.coalesce("measured_companions", no_names))
    )

    def rule(df: DataFrame, name: str, when: Column, **changes: Column) -> DataFrame:
        hit = F.coalesce(when, F.lit(False))
        marked = df.withColumn("__hit", hit)
        changed = {c: F.when(F.col("__hit"), new).otherwise(F.col(c)) for c, new in changes.items()}
        changed["rules"] = F.when(F.col("__hit"), F.array_append("rules", F.lit(name))).otherwise(F.col("rules"))
        return marked.withColumns(changed).drop("__hit")

    none = F.array(F.lit("none"))
    targets = F.col("target_tables")
    for field in ("group_by_columns", "entity_key_columns"):
        known = _only(F.col(field), F.col("columns"))
        rows = rule(rows, "unknown_column", F.size(known) != F.size(field), **{field: known})
    any_slot = rows.filter(F.array_contains("target_tables", STORAGE_TABLE) & F.col("slot_column").isNotNull())
    slot_ready = any_slot.select(F.count(F.lit(1)).alias("n")).scalar() > 0
    left_over = F.array_remove("target_tables", STORAGE_TABLE)
    loses = slot_ready & F.array_contains("target_tables", STORAGE_TABLE) & F.col("slot_column").isNull()
    rows = rule(
        rows, "storage_source", loses,
        loadable=F.when(F.size(left_over) == 0, F.lit(False)).otherwise(F.col("loadable")),
        target_tables=F.when(F.size(left_over) == 0, none).otherwise(left_over),
    )
    in_keys = F.array_contains("target_tables", STORAGE_TABLE) & F.array_contains("group_by_columns", F.col("slot_column"))
    rows = rule(
        rows, "slot_not_a_key", in_keys, group_by_columns=F.array_remove("group_by_columns", F.col("slot_column"))
    )
    children = F.arrays_overlap("target_tables", F.array(*[F.lit(t) for t in RECIPE_TABLES[1:]]))
    rows = rule(
        rows, "recipe_fk", children & ~F.array_contains("target_tables", "recipe"),
        target_tables=F.array_prepend("target_tables", F.lit("recipe")),
    )
    keys = F.when(F.size("group_by_columns") > 0, F.col("group_by_columns")).otherwise(F.col("entity_key_columns"))
    own_keys = rows.select("dataset", F.explode(keys).alias("key"))
    partner_columns = columns.select(F.col("dataset").alias("other"), F.explode("columns").alias("key"))
    profiled = profiles.select(F.col("dataset").alias("other"))
    partnered = (
        own_keys.join(both, "dataset")
        .join(profiled, "other", "left_semi")
        .join(partner_columns, ["other", "key"], "left_semi")
        .select("dataset")
        .distinct()
        .withColumn("partnered", F.lit(True))
    )
    rows = rows.join(partnered, "dataset", "left")
    rows = rule(
        rows, "companion_pair", ~F.col("loadable") & F.col("targets_recipe") & F.col("partnered"),
        loadable=F.lit(True), target_tables=F.array(F.lit("recipe"), F.lit("recipe_ingredient")),
    )
    no_key = (F.size("group_by_columns") == 0) & (F.size("entity_key_columns") == 0)
    rows = rule(
        rows, "missing_group_key", F.col("loadable") & (F.col("rows_per_entity") == "many") & no_key,
        loadable=F.lit(False), target_tables=none,
    )
    rows = durable(rows.drop("partnered", "measured_companions"))
    groups = connected_groups(both.select(F.col("dataset").alias("left"), F.col("other").alias("right")),
                              metadata.select("name")).withColumnRenamed("name", "dataset")
    grouped = rows.join(groups, "dataset").filter("loadable")
    wanted = (
        grouped.select("group", "dataset", F.explode(targets).alias("target"))
        .groupBy("group")
        .agg(F.array_remove(F.array_sort(F.collect_set("target")), "none").alias("union_tables"),
             F.countDistinct("dataset").alias("members"), F.min("dataset").alias("primary"))
    )
    recipe_family = F.size(F.array_except("union_tables", F.array(*[F.lit(t) for t in RECIPE_TABLES]))) == 0
    storage_family = F.size(F.array_except("union_tables", F.array(F.lit(STORAGE_TABLE)))) == 0
    families = wanted.filter((F.col("members") >= 2) & (F.size("union_tables") > 0) & (recipe_family | storage_family))
    rows = rows.join(groups, "dataset").join(families, "group", "left")
    in_family = F.col("primary").isNotNull() & F.col("loadable")
    is_primary = F.col("dataset") == F.col("primary")
    same = F.array_sort("target_tables") == F.col("union_tables")
    rows = rule(rows, "companion_primary", in_family & is_primary & ~same, target_tables=F.col("union_tables"))
    rows = rule(rows, "companion_primary", in_family & ~is_primary, loadable=F.lit(False), target_tables=none)
    return rows.drop("group", "union_tables", "members", "primary", "columns", "slot_column")


# ---------------------------------------------------------------- tables


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, offending): rows breaking each rule, zero included, in one pass."""
    counts = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(name).alias("offending")) for name in rules]
    return counts.select(F.explode(F.array(*pairs)).alias("x")).select("x.rule", "x.offending")


def constraint_guards(ingredient: DataFrame, product: DataFrame, product_key: list[str]) -> DataFrame:
    """(rule, offending) before constraints are switched on."""

    def counted(rule: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("offending")).select(F.lit(rule).alias("rule"), "offending")

    ids = ingredient.select(F.col("ingredient_id").alias("parent_ingredient_id"))
    with_parent = ingredient.filter(F.col("parent_ingredient_id").isNotNull())
    return (
        counted("duplicate ingredient key", duplicate_keys(ingredient, ["source_identity_key"]))
        .unionByName(counted("duplicate product key", duplicate_keys(product, product_key)))
        .unionByName(counted("orphan parent", with_parent.join(ids, "parent_ingredient_id", "left_anti")))
        .unionByName(
            counted("own parent", with_parent.filter(F.col("parent_ingredient_id") == F.col("ingredient_id")))
        )
        .unionByName(counted("negative stock", product.filter(F.col("stock_quantity") < 0)))
    )


def deep_hierarchy(ingredient: DataFrame) -> DataFrame:
    """Ingredients whose parent has a parent."""
    parents = ingredient.filter(F.col("parent_ingredient_id").isNotNull()).select(
        F.col("ingredient_id").alias("parent_ingredient_id")
    )
    return ingredient.join(parents, "parent_ingredient_id", "left_semi")


def missing_ids(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Ids asked for that do not exist."""
    return wanted.select(key).distinct().join(existing.select(key), key, "left_anti")


def set_differences(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in one set only, with the ``side`` that has them; empty when the sets are equal."""
    a, e = actual.select(*keys).distinct(), expected.select(*keys).distinct()
    return (
        a.join(e, keys, "left_anti")
        .withColumn("side", F.lit("unexpected"))
        .unionByName(e.join(a, keys, "left_anti").withColumn("side", F.lit("missing")))
    )


def residue(marked: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(table_name, residue): rows still carrying a test mark."""
    result = None
    for name, (df, mark) in marked.items():
        part = df.agg(F.count_if(mark).alias("residue")).select(F.lit(name).alias("table_name"), "residue")
        result = part if result is None else result.unionByName(part)
    return result


def count_mismatches(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, source_rows, target_rows) where two catalogs differ in size."""
    result = None
    for name, df in source.items():
        left = df.agg(F.count(F.lit(1)).alias("source_rows"))
        right = target[name].agg(F.count(F.lit(1)).alias("target_rows"))
        part = left.select(F.lit(name).alias("table_name"), "source_rows").withColumn(
            "target_rows", right.scalar()
        )
        result = part if result is None else result.unionByName(part)
    return result.filter(F.col("source_rows") != F.col("target_rows"))


def filled_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of the tables that must be empty and are not."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).filter("row_count > 0")


def step_violations(steps: DataFrame) -> DataFrame:
    """Recipe steps with ``problem``: a number below 1, or neither text nor image."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    problem = F.when(~(F.coalesce("step_no", F.lit(0)) > 0), "step_no").when(
        blank("instruction") & blank("image_url"), "content"
    )
    return steps.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def recommendation_problems(rows: DataFrame) -> DataFrame:
    """Recommendation rows with ``problem``: the first invariant their lists and counts break, or NULL.

    Lists are counted over all pages of a (user, recipe).
    """

    def entries(name: str) -> Column:
        return F.sum(F.size(name)).over(Window.partitionBy("user_id", "recipe_id"))

    have, pantry = entries("held_ingredients"), entries("pantry_ingredients")
    rate = F.col("available_count") / F.col("required_count")
    problem = (
        F.when(have + pantry != F.col("available_count"), "available")
        .when(entries("missing_ingredients") != F.col("missing_count"), "missing")
        .when(F.col("required_count") != F.col("available_count") + F.col("missing_count"), "sum")
        .when(F.col("required_count") == 0, "empty")
        .when(F.abs(F.col("match_rate").cast("double") - rate) > fixed.RATE_TOLERANCE, "rate")
    )
    return rows.withColumn("problem", problem)


def case_drift(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases against earlier results by id: drifted, unverified (no fingerprint kept), missing or same."""
    earlier = results.select("case_id", "case_hash", F.lit(True).alias("known"))
    status = (
        F.when(F.col("known").isNull(), "missing")
        .when(nonempty(F.col("case_hash")).isNull(), "unverified")
        .when(F.col("case_hash") != F.col("fingerprint"), "drifted")
        .otherwise("same")
    )
    return cases.select("case_id", "fingerprint").join(earlier, "case_id", "left").withColumn("status", status).drop(
        "known"
    )


def configured_products(config: DataFrame, catalog: Catalog) -> DataFrame:
    """Configured products with ``problem``: absent, other name, other main ingredient, or NULL."""
    links = catalog.product_ingredient.filter(F.col("role") == fixed.PRIMARY).select("product_id", "ingredient_id")
    names = catalog.ingredient.select("ingredient_id", F.col("name").alias("ingredient_name"))
    main = links.join(names, "ingredient_id")
    agrees = (
        config.select("product_id", F.col("expected_ingredient").alias("ingredient_name"))
        .join(main.select("product_id", "ingredient_name"), ["product_id", "ingredient_name"], "left_semi")
        .select("product_id")
        .distinct()
        .withColumn("agrees", F.lit(True))
    )
    found = catalog.product.select("product_id", F.col("name").alias("actual_name"))
    problem = (
        F.when(F.col("actual_name").isNull(), "absent")
        .when(F.col("actual_name") != F.col("expected_name"), "other name")
        .when(F.col("agrees").isNull(), "other main ingredient")
    )
    return (
        config.join(found, "product_id", "left").join(agrees, "product_id", "left").withColumn("problem", problem)
        .drop("agrees")
    )


def scenario_checks(
    catalog: Catalog,
    held: DataFrame,
    expected: DataFrame,
    priority: int,
    users: DataFrame,
    named: DataFrame,
    stocked: DataFrame,
    below: DataFrame,
) -> DataFrame:
    """(user_id, recipe_id, check, off, passed) of configured situations; ``off`` counts what differs.

    ``expected`` has one row per (user_id, recipe_id, ingredient_id, product_id): the ingredients
    that must turn out missing and the product that must fill each. ``users`` are the known users, ``named`` the recipes
    (recipe_id, name) as the configuration spells them, ``stocked`` the active products (user_id, product_id) that must be in
    the fridge, and ``below`` the ingredients (user_id, ingredient_id) that a held child must stand for.
    """
    pair = ["user_id", "recipe_id"]
    count = F.count(F.lit(1))
    situations = expected.select(*pair).distinct()
    wanted = expected.select(*pair, "ingredient_id").distinct()
    required = catalog.recipe_ingredient.filter("is_required").select("recipe_id", "ingredient_id")
    needed = situations.join(required, "recipe_id").join(
        catalog.ingredient.filter(~F.col("is_pantry")).select("ingredient_id"), "ingredient_id", "left_semi"
    )
    missing = needed.join(held, ["user_id", "ingredient_id"], "left_anti").select(*pair, "ingredient_id")
    buyable = (
        catalog.product_ingredient.filter(F.col("role") == fixed.PRIMARY)
        .join(
            catalog.product.filter("is_active AND (stock_quantity IS NULL OR stock_quantity > 0)"),
            "product_id",
            "left_semi",
        )
        .select("ingredient_id")
        .distinct()
    )
    designated = catalog.recipe_product.filter(F.col("recommendation_priority") == priority)
    active = catalog.user_fridge.join(catalog.product.filter("is_active"), "product_id", "left_semi").select("user_id", "product_id")
    asked = situations.select("user_id").distinct()
    n_users = users.groupBy("user_id").agg(count.alias("n_users"))
    n_recipes = catalog.recipe.groupBy("recipe_id").agg(count.alias("n_recipes"))
    not_one = lambda c: (F.coalesce(c, F.lit(0)) != 1).cast("int")
    known = situations.join(n_users, "user_id", "left").join(n_recipes, "recipe_id", "left")
    spelled = catalog.recipe.select("recipe_id", "name")
    slots = ["user_id", "product_id"]
    by_pair = [
        known.select(*pair, (not_one("n_users") + not_one("n_recipes")).alias("absent")),
        set_differences(missing, wanted, [*pair, "ingredient_id"]).groupBy(*pair).agg(count.alias("unlike")),
        wanted.join(buyable, "ingredient_id", "left_anti").groupBy(*pair).agg(count.alias("unbuyable")),
        expected.join(designated, ["recipe_id", "product_id"], "left_anti").groupBy(*pair).agg(count.alias("unranked")),
    ]
    fridge = [rows.join(asked, "user_id", "left_semi").select(*slots) for rows in (active, stocked)]
    by_user = [
        set_differences(*fridge, slots).groupBy("user_id").agg(count.alias("unstocked")),
        below.join(held, ["user_id", "ingredient_id"], "left_anti").groupBy("user_id").agg(count.alias("unreached")),
    ]
    parents = catalog.ingredient.filter(F.col("parent_ingredient_id").isNotNull())
    upper = parents.select(F.col("ingredient_id").alias("parent_ingredient_id"))
    deep = parents.join(upper, "parent_ingredient_id", "left_semi").count()  # one number for all situations
    renamed = named.join(spelled, ["recipe_id", "name"], "left_anti").groupBy("recipe_id").agg(count.alias("renamed"))
    rows = situations.join(renamed, "recipe_id", "left").withColumn("deep", F.lit(deep))
    for part in by_pair:
        rows = rows.join(part, pair, "left")
    for part in by_user:
        rows = rows.join(part, "user_id", "left")
    checks = [
        ("user and recipe are there once", "absent"),
        ("recipes named as configured", "renamed"),
        ("active products in the fridge as configured", "unstocked"),
        ("held children reach their parents", "unreached"),
        ("missing as configured", "unlike"),
        ("every missing one buyable", "unbuyable"),
        ("designated priority", "unranked"),
        ("hierarchy of one level", "deep"),
    ]
    entries = [F.struct(F.lit(name).alias("check"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("off")) for name, c in checks]
    told = rows.select(*pair, F.explode(F.array(*entries)).alias("x")).select(*pair, "x.check", "x.off")
    return told.withColumn("passed", F.col("off") == 0)
