"""Upsert over plain files: one full outer join on the key and a rule per column.

Parquet has no MERGE, so the operator returns the next version of the table. ``target`` and
``source`` must each be unique on the key (the callers reduce their input first), so the join has
at most one row per key on each side and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.functions.catalog_values import merge_json as _merge_json
from mealgrid.functions.catalog_values import merged_aliases

Rule = Callable[[Column, Column], Column]
"""(new value, old value) → value to keep for a key both sides have."""

ACTION = "action"


def overwrite(new: Column, old: Column) -> Column:
    """The new value, even when it is NULL."""
    return new


def keep_if_null(new: Column, old: Column) -> Column:
    """The new value unless it is NULL."""
    return F.coalesce(new, old)


def keep_if_empty_list(new: Column, old: Column) -> Column:
    """The new list unless it is empty."""
    return F.when(F.size(new) == 0, old).otherwise(new)


def keep_if_empty_json(new: Column, old: Column) -> Column:
    """The new JSON object unless it is ``{}``."""
    return F.when(F.replace(new, F.lit(" "), F.lit("")) == "{}", old).otherwise(new)


def merge_json(new: Column, old: Column) -> Column:
    """Old and new JSON objects merged, new keys win."""
    return _merge_json(old, new)


def merge_aliases(new: Column, old: Column) -> Column:
    """Sorted union of both lists."""
    return merged_aliases(old, new)


def increment(new: Column, old: Column) -> Column:
    """Old plus new."""
    return old + new


def insert_only(new: Column, old: Column) -> Column:
    """The old value; the new one only reaches keys that did not exist."""
    return old


def patch(flag: str) -> Rule:
    """The new value (also NULL) where the source's ``flag`` is true, otherwise the old one."""
    return lambda new, old: F.when(F.col(f"s.{flag}"), new).otherwise(old)


def merge_table(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    rules: Mapping[str, Rule],
    update_when: Column | None = None,
    insert: bool = True,
) -> DataFrame:
    """Next version of ``target`` with an ``action`` column (inserted / updated / kept).

    Columns of ``target`` without a rule keep their old value (NULL for inserted rows).
    ``update_when`` may refer to ``t.column`` and ``s.column``; rows that fail it stay as they are.
    With ``insert=False`` unknown keys are ignored.
    """
    t = target.withColumn("__in_target", F.lit(True)).alias("t")
    s = source.withColumn("__in_source", F.lit(True)).alias("s")
    match = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = t.join(s, match, "full" if insert else "left")
    known, given = F.col("__in_target").isNotNull(), F.col("__in_source").isNotNull()
    changes = known & given
    if update_when is not None:
        changes = changes & F.coalesce(update_when, F.lit(False))
    columns = []
    for field in target.schema.fields:
        name = field.name
        old = F.col(f"t.{name}")
        if name in keys:
            value = F.coalesce(old, F.col(f"s.{name}"))
        elif name in rules:
            new = F.col(f"s.{name}").cast(field.dataType.simpleString())
            value = F.when(~known, new).when(changes, rules[name](new, old)).otherwise(old)
        else:
            value = old
        columns.append(value.alias(name))
    action = F.when(~known, "inserted").when(changes, "updated").otherwise("kept")
    return joined.select(*columns, action.alias(ACTION))


def action_counts(merged: DataFrame) -> DataFrame:
    """Rows per action."""
    return merged.groupBy(ACTION).agg(F.count(F.lit(1)).alias("n"))
