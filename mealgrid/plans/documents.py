"""Texts per catalog row: what is embedded, what a search hit shows, and what is still to embed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.core.catalog import Catalog
from mealgrid.functions.text import nonempty, stripped


def _ordered_names(lines: DataFrame, key: str, separator: str, *order: Column) -> DataFrame:
    """Ingredient names of one recipe or product as one text."""
    entry = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("ingredient_name"))
    names = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["ingredient_name"])
    return lines.groupBy(key).agg(F.array_join(names, separator).alias("names"))


def _named_recipe_lines(catalog: Catalog) -> DataFrame:
    names = catalog.ingredient.select("ingredient_id", F.col("name").alias("ingredient_name"))
    return catalog.recipe_ingredient.select("recipe_id", "ingredient_id", "is_required").join(names, "ingredient_id")


def _named_product_lines(catalog: Catalog) -> DataFrame:
    names = catalog.ingredient.select("ingredient_id", F.col("name").alias("ingredient_name"))
    return catalog.product_ingredient.select("product_id", "ingredient_id").join(names, "ingredient_id")



def _recipe_names(catalog: Catalog, separator: str) -> DataFrame:
    order = (~F.col("is_required"), F.col("ingredient_name"), F.col("ingredient_id"))
    return _ordered_names(_named_recipe_lines(catalog), "recipe_id", separator, *order)


def recipe_embedding_text(catalog: Catalog) -> DataFrame:
    """Name, description, ingredients (required first), tags and method; missing parts are left out."""
    body = F.concat_ws(" ", "name", "description", "names", F.array_join("tags", " "), "cooking_method")
    return catalog.recipe.join(_recipe_names(catalog, " "), "recipe_id", "left").withColumn("body", body)


def recipe_body(catalog: Catalog) -> DataFrame:
    """What a recipe hit shows."""
    body = F.concat_ws(
        " / ", nonempty(F.col("description")), "names", nonempty(F.array_join("tags", ", ")), "cooking_method"
    )
    rows = catalog.recipe.join(_recipe_names(catalog, ", "), "recipe_id", "left")
    return rows.select(F.lit("recipe").alias("source"), F.col("recipe_id").alias("doc_id"), F.col("name").alias("title"),
                       body.alias("body"))


def product_body(catalog: Catalog) -> DataFrame:
    """What a product hit shows."""
    names = _ordered_names(
        _named_product_lines(catalog), "product_id", ", ", F.col("ingredient_name"), F.col("ingredient_id")
    )
    category = catalog.category.select("category_id", F.col("name").alias("category_name"))
    body = F.concat_ws(" / ", "category_name", nonempty(F.col("origin_country")), "names", "storage_type")
    rows = catalog.product.join(category, "category_id", "left").join(names, "product_id", "left")
    return rows.select(F.lit("product").alias("source"), F.col("product_id").alias("doc_id"),
                       F.col("name").alias("title"), body.alias("body"))


def ingredient_body(catalog: Catalog) -> DataFrame:
    """What an ingredient hit shows."""
    body = F.concat_ws(" / ", F.nullif("normalized_name", F.col("name")), F.array_join("aliases", ", "))
    return catalog.ingredient.select(
        F.lit("ingredient").alias("source"), F.col("ingredient_id").alias("doc_id"), F.col("name").alias("title"),
        body.alias("body"),
    )


def embedding_targets(rows: DataFrame, text: str, refresh: bool = False) -> DataFrame:
    """Rows whose vector is missing (all of them on refresh) and whose text is not empty."""
    due = F.lit(True) if refresh else F.col("embedding").isNull()
    return rows.filter(due & (stripped(F.col(text)) != ""))


def empty_texts(rows: DataFrame, text: str) -> DataFrame:
    """Number of rows that cannot be embedded because their text is empty."""
    return rows.agg(F.count_if(F.coalesce(stripped(F.col(text)), F.lit("")) == "").alias("empty_texts"))


VERSION_BYTES = 1024 * 1024  # bytes of a file that travel in one row


def _running_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = hashlib.sha256()
    for batch in batches:
        for piece in batch.column("piece"):
            digest.update(piece.as_buffer())
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["digest"])


def content_version(spark: SparkSession, path: str) -> DataFrame:
    """First 12 hex digits of the digest of all configuration files below ``path``, one after the other in path order.

    Files are cut into pieces where they are read, and the pieces are sorted by file and place. A digest has to see its bytes
    in turn, so one task goes through the sorted pieces; it holds one batch of them and the state of the digest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("content") - 1, F.lit(0)) / VERSION_BYTES).cast("int"))
    pieces = files.withColumn("k", F.explode(starts)).select(
        "path", "k", F.substring("content", F.col("k") * VERSION_BYTES + 1, F.lit(VERSION_BYTES)).alias("piece")
    )
    ordered = pieces.repartition(1).sortWithinPartitions("path", "k").select("piece")
    return ordered.mapInArrow(_running_digest, "digest string").select(F.substring("digest", 1, 12).alias("version"))
