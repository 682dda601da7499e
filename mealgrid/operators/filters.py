"""Row filters and predicates used by several relations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.core.clock import days_before, moment
from mealgrid.functions import fixed_values as fixed


def is_unexpired(as_of, column: str = "expires_at") -> Column:
    """No expiry date, or one not before ``as_of``."""
    return F.col(column).isNull() | (F.col(column) >= moment(as_of))


def unexpired(fridge: DataFrame, as_of) -> DataFrame:
    """Fridge rows that are still good."""
    return fridge.filter(is_unexpired(as_of))


def purchasable(product: DataFrame) -> DataFrame:
    """Active products whose stock is unknown (NULL) or positive."""
    return product.filter(F.col("is_active") & (F.col("stock_quantity").isNull() | (F.col("stock_quantity") > 0)))


def primary_only(links: DataFrame) -> DataFrame:
    """Product-ingredient links of the main ingredient."""
    return links.filter(F.col("role") == fixed.PRIMARY)


def stale_purchases(affinity: DataFrame, as_of, days: int) -> DataFrame:
    """Products last bought more than ``days`` days ago."""
    return affinity.filter(F.col("last_purchased_at") < days_before(as_of, days))


def nonblank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text has something besides blanks."""
    return df.filter(F.trim(F.col(column)) != "")


def with_ratio_at_least(df: DataFrame, part: str, whole: str, bound: float) -> DataFrame:
    """Rows with ``part / whole`` (unrounded) at or above the bound; a zero whole never qualifies."""
    return df.filter((F.col(whole) > 0) & (F.col(part) / F.col(whole) >= F.lit(bound)))


def edible_categories(category: DataFrame, source: str) -> DataFrame:
    """Drop categories of one source whose metadata says they are not edible."""
    meta = F.col("metadata")
    dropped = (F.get_json_object(meta, "$.source") == source) & (
        F.lower(F.get_json_object(meta, "$.is_edible")) == "false"
    )
    return category.filter(~F.coalesce(dropped, F.lit(False)))


def complete_rows(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows having every required field, one row with the number skipped)."""
    ok = F.lit(True)
    for name in required:
        ok = ok & F.col(name).isNotNull()
    return df.filter(ok), df.agg(F.count_if(~ok).alias("skipped"))


def steps_with_content(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps having a text or an image, one row with the number skipped)."""
    has = F.coalesce(F.col("instruction"), F.col("image_url")).isNotNull()
    return steps.filter(has), steps.agg(F.count_if(~has).alias("skipped"))


def replace_values(column: Column, mapping: Mapping[str, str]) -> Column:
    """Map listed values, keep every other value."""
    result = column
    for old, new in mapping.items():
        result = F.when(column == old, F.lit(new)).otherwise(result)
    return result


def recipe_card(df: DataFrame, *extra: str) -> DataFrame:
    """The narrow columns a recipe list shows."""
    return df.select(*extra, "recipe_id", "name", "image_url", "difficulty", "cook_time_min", "servings")
