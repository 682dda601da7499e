"""Storage labels and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.text import nonempty, stripped


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def product_storage(column: Column) -> Column:
    """Shop storage code → label; known labels pass, anything else is NULL."""
    known = F.when(column.isin(*fixed.PRODUCT_STORAGE.values()), column)
    return F.coalesce(known, _lookup(fixed.PRODUCT_STORAGE, F.upper(column)))


def duration_unit(column: Column) -> Column:
    """Unit spelling → label; unknown spellings stay, blanks become NULL."""
    text = nonempty(stripped(column))
    return F.coalesce(_lookup(fixed.DURATION_UNITS, F.lower(text)), text)


def slot_location(slot: Column) -> Column:
    """Storage place of a source slot; NULL for an unknown slot."""
    return _lookup({k: v[0] for k, v in fixed.STORAGE_SLOTS.items()}, slot)


def slot_context(slot: Column) -> Column:
    """Storage context of a source slot; NULL for an unknown slot."""
    return _lookup({k: v[1] for k, v in fixed.STORAGE_SLOTS.items()}, slot)


def duration_triplet(minimum: Column, maximum: Column, unit: Column) -> tuple[Column, Column, Column]:
    """Minimum, maximum and unit: all present or all NULL."""
    complete = minimum.isNotNull() & maximum.isNotNull() & unit.isNotNull()
    return F.when(complete, minimum), F.when(complete, maximum), F.when(complete, unit)


def duration_days(unit: str | None = "duration_unit") -> Column:
    """Upper (else lower) bound in days.

    NULL when the unit is missing; with ``unit=None`` the number is taken as days.
    """
    bound = F.coalesce("duration_max", "duration_min").cast("double")
    if unit is None:
        return bound
    label = F.col(unit)
    days = F.when(label == fixed.HOUR_UNIT, bound / F.lit(fixed.HOURS_PER_DAY))
    for name, factor in fixed.UNIT_DAYS.items():
        days = days.when(label == name, bound * F.lit(factor))
    return days.when(label.isNotNull(), bound)
