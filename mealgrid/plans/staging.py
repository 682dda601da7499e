"""Raw and extracted records → typed staging rows.

"First one wins" always refers to an ``ordinal`` column carried from the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mealgrid.core.nesting import add_page, nested
from mealgrid.core.ranking import first_row
from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.catalog_values import (
    category_path,
    clean_integer,
    clean_number,
    compact_map,
    json_or_raw,
    merge_json,
    path_depth,
)
from mealgrid.functions.recipe_text import cooking_method
from mealgrid.functions.storage import duration_triplet, duration_unit, slot_context, slot_location
from mealgrid.functions.text import clean_text, entity_key, match_key, nonempty, stripped, truncated


def keep_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of every key by ordinal."""
    return first_row(rows, keys, [F.col("ordinal").asc()])


def unique_sku(products: DataFrame) -> DataFrame:
    """A SKU stays with its first product, later ones lose it; the rows all stay.

    The first owner is a partial + final minimum per SKU, joined back: a SKU shared by very many
    rows is never gathered in one place.
    """
    owners = (
        products.filter(F.col("sku").isNotNull())
        .groupBy("sku")
        .agg(F.min("ordinal").alias("first_ordinal"))
    )
    return (
        products.join(owners, "sku", "left")
        .withColumn("sku", F.when(F.col("ordinal") == F.col("first_ordinal"), F.col("sku")))
        .drop("first_ordinal")
    )


def category_rows(raw: DataFrame) -> DataFrame:
    """Category rows: path, parent, depth (counted when missing), metadata with defaults filled in.

    ``raw`` has category_type, name, parent_path, depth, metadata, source, source_code, is_edible and
    ordinal. Keys already in the metadata win over the columns.
    """
    name, kind = clean_text(F.col("name")), clean_text(F.col("category_type"))
    path = category_path(F.coalesce(clean_text(F.col("parent_path")), F.lit("")), name)
    defaults = F.to_json(F.struct(*[clean_text(F.col(c)).alias(c) for c in ("source", "source_code", "is_edible")]))
    rows = raw.filter(name.isNotNull() & kind.isNotNull()).select(
        path.alias("path"),
        F.coalesce(clean_text(F.col("parent_path")), F.lit("")).alias("parent_path"),
        kind.alias("category_type"),
        name.alias("name"),
        F.coalesce(clean_integer(F.col("depth")), path_depth(path)).alias("depth"),
        merge_json(defaults, json_or_raw(F.col("metadata"))).alias("metadata"),
        "ordinal",
    )
    return keep_first(rows, ["path"])


_LISTED = "array<string>"
_OBJECTS = "array<struct<name:string,normalized_name:string,role:string,quantity_g:string,ratio:string>>"


def product_ingredient_rows(raw: DataFrame) -> DataFrame:
    """(source, product, ingredient key) from ingredient JSON: a list of names or of objects.

    The first entry of a key within a product stays; the role defaults to the main one.
    """
    items = F.posexplode(F.from_json("ingredients", _LISTED)).alias("pos", "item")
    rows = raw.select("source_type", "source_product_id", "ordinal", items)
    is_object = F.startswith(F.ltrim("item"), F.lit("{"))
    parsed = F.element_at(F.from_json(F.concat(F.lit("["), F.col("item"), F.lit("]")), _OBJECTS), 1)
    entry = rows.withColumn("o", F.when(is_object, parsed))
    name = F.when(is_object, F.coalesce(nonempty(F.col("o.normalized_name")), F.col("o.name"))).otherwise(F.col("item"))
    keyed = entry.withColumn("normalized_name", match_key(F.coalesce(name, F.lit("")))).filter(
        F.col("normalized_name") != ""
    )
    first = F.min(F.struct("ordinal", "pos", "o.role", "o.quantity_g", "o.ratio")).alias("first")
    return (
        keyed.groupBy("source_type", "source_product_id", "normalized_name")
        .agg(first)
        .select(
            "source_type",
            "source_product_id",
            "normalized_name",
            F.coalesce(clean_text(F.col("first.role")), F.lit(fixed.PRIMARY)).alias("role"),
            clean_number(F.col("first.quantity_g"), 2).alias("quantity_g"),
            clean_number(F.col("first.ratio"), 5).alias("ratio"),
        )
    )


def match_rates(records: DataFrame, matches: DataFrame) -> DataFrame:
    """(source_recipe_id, match_rate): share of a record's ingredient lines known to the master."""
    keys = records.select("source_recipe_id", F.explode("ingredients").alias("i")).select(
        "source_recipe_id", match_key(F.coalesce("i.normalized_name", F.lit(""))).alias("normalized_name")
    )
    known = matches.select("normalized_name").distinct().withColumn("known", F.lit(1))
    return (
        keys.filter(F.col("normalized_name") != "")
        .join(known, "normalized_name", "left")
        .groupBy("source_recipe_id")
        .agg(F.avg(F.coalesce("known", F.lit(0))).alias("match_rate"))
    )


def loadable_records(records: DataFrame, matches: DataFrame, floor: float = fixed.MIN_MATCH_RATE) -> DataFrame:
    """Records without translated recipes whose match rate is below the floor.

    A record with an original name is a translation; others are always kept.
    """
    translated = nonempty(stripped(F.coalesce("name_original", F.lit("")))).isNotNull()
    rate = F.coalesce("match_rate", F.lit(0.0))
    return (
        records.join(match_rates(records, matches), "source_recipe_id", "left")
        .filter(~translated | (rate >= floor))
        .drop("match_rate")
    )


def recipe_rows(records: DataFrame) -> DataFrame:
    """One staged recipe per record with an id and a name."""
    return records.select(
        nonempty(stripped(F.col("source_recipe_id"))).alias("source_id"),
        truncated(F.col("name"), 255).alias("name"),
        "description",
        truncated(F.col("difficulty"), 20).alias("difficulty"),
        "cook_time_min",
        cooking_method(truncated(F.col("cooking_method"), 50)).alias("cooking_method"),
        compact_map(F.col("nutrition")).alias("nutrition"),
        F.filter(F.transform("tags", stripped), lambda t: t != "").alias("tags"),
    ).filter(F.col("source_id").isNotNull() & F.col("name").isNotNull())


def recipe_line_rows(records: DataFrame, matches: DataFrame) -> DataFrame:
    """Staged lines with ``known``: false for lines to be skipped because the master lacks the name."""
    lines = records.select("source_recipe_id", F.posexplode("ingredients").alias("pos", "i"))
    known = matches.select("normalized_name").distinct().withColumn("known", F.lit(True))
    key = match_key(F.coalesce("i.normalized_name", F.lit("")))
    return (
        lines.select(
            F.col("source_recipe_id").alias("source_id"),
            (F.col("pos") + 1).alias("line_no"),
            F.substring(F.coalesce("i.raw_text", F.lit("")), 1, 1000).alias("raw_text"),
            F.coalesce(truncated(F.col("i.name"), 255), key).alias("name"),
            F.substring(key, 1, 255).alias("normalized_name"),
            F.coalesce("i.is_required", F.lit(True)).alias("is_required"),
        )
        .filter(F.col("normalized_name") != "")
        .join(known, "normalized_name", "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
    )


def recipe_step_rows(records: DataFrame) -> DataFrame:
    """Steps with a text or an image, renumbered 1..n; a numbering group is one record's own array."""
    kept = (
        records.select("source_recipe_id", F.posexplode("steps").alias("pos", "s"))
        .select(
            F.col("source_recipe_id").alias("source_id"),
            "pos",
            nonempty(stripped(F.col("s.instruction"))).alias("instruction"),
            truncated(F.col("s.image_url"), 2000).alias("image_url"),
        )
        .filter(F.coalesce("instruction", "image_url").isNotNull())
    )
    step_no = F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))
    return kept.withColumn("step_no", step_no).drop("pos")


def storage_rule_rows(items: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per storage rule of known items; an unknown slot is an error, a blank duration is left out."""
    known = matches.select("normalized_name", "ingredient_id")
    slot = stripped(F.col("r.source_slot"))
    unknown = F.raise_error(F.concat(F.lit("unknown storage slot: "), F.coalesce(slot, F.lit("NULL"))))
    low, high, unit = duration_triplet(
        F.col("r.duration_min"), F.col("r.duration_max"), duration_unit(F.col("r.duration_unit"))
    )
    return (
        items.withColumn("normalized_name", match_key(F.coalesce("normalized_name", F.lit(""))))
        .join(known, "normalized_name")
        .select("source_item_id", "ingredient_id", F.explode("rules").alias("r"))
        .filter(stripped(F.coalesce("r.duration_text", F.lit(""))) != "")
        .select(
            "source_item_id",
            "ingredient_id",
            slot.alias("source_slot"),
            F.coalesce(slot_location(slot), unknown).alias("storage_location"),
            slot_context(slot).alias("storage_context"),
            low.alias("duration_min"),
            high.alias("duration_max"),
            unit.alias("duration_unit"),
            stripped(F.col("r.duration_text")).alias("duration_text"),
        )
    )


def skipped_rules(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Number of rules whose item has no ingredient."""
    keyed = items.withColumn("normalized_name", match_key(F.coalesce("normalized_name", F.lit(""))))
    return keyed.join(matches.select("normalized_name"), "normalized_name", "left_anti").agg(
        F.coalesce(F.sum(F.size("rules")), F.lit(0)).alias("skipped")
    )


def build_entities(
    rows: DataFrame, keys: list[str], row_no: Column, companions: dict[str, tuple[DataFrame, str]], one: bool = False
):
    """(entity_key, page, rows, companions…): rows grouped by entity with companion rows nested.

    With ``one`` every row is an entity: the first row of a key keeps it, others append their number.

    ``companions`` maps a name to (frame, its key column). Arrays hold one page of rows each; an
    entity with very many rows has several pages.
    """
    keyed = rows.withColumn("entity_key", entity_key([F.col(k) for k in keys], row_no))
    if one:
        # only the smallest number per key is looked up, so a frequent key is no group of rows
        first = keyed.groupBy("entity_key").agg(F.min(row_no).alias("__first"))
        numbered = F.concat("entity_key", F.lit("#"), row_no.cast("string"))
        keyed = keyed.join(first, "entity_key").withColumn(
            "entity_key", F.when(row_no == F.col("__first"), F.col("entity_key")).otherwise(numbered)
        ).drop("__first")

    def cells(df: DataFrame, name: str) -> DataFrame:
        columns = [c for c in df.columns if c not in ("entity_key", "page")]
        order = {c: F.col(c).cast("string") for c in columns}
        return (
            add_page(df, ["entity_key"], order)
            .groupBy("entity_key", "page")
            .agg(nested(order, {c: F.col(c) for c in columns}).alias(name))
        )

    result = cells(keyed, "rows")
    entities = keyed.select("entity_key").distinct()
    for name, (frame, key) in companions.items():
        own = frame.withColumn("entity_key", stripped(F.col(key).cast("string"))).join(
            entities, "entity_key", "left_semi"
        )
        result = result.join(cells(own, name), ["entity_key", "page"], "full")
    return result


def target_shape(target_tables: Column) -> Column:
    """Record shape to extract for a profile; NULL when neither kind of table is its target."""
    return F.when(F.array_contains(target_tables, "storage_guideline"), "storage").when(
        F.array_contains(target_tables, "recipe"), "recipe"
    )
