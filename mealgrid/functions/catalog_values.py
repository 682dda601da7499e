"""Raw catalogue values → typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.text import clean_text, nonempty, stripped, unicode_pattern


def clean_number(column: Column, places: int) -> Column:
    """Digits, dot and minus of a raw value as a rounded decimal; NULL when that is no number."""
    digits = F.regexp_replace(clean_text(column), unicode_pattern(r"[^\d.\-]"), "")
    return F.bround(digits.try_cast("double"), places).try_cast(f"decimal(18,{places})")


def clean_integer(column: Column) -> Column:
    """Like :func:`clean_number` for whole numbers."""
    return clean_number(column, 0).cast("int")


def finite_json(column: Column) -> Column:
    """JSON text with bare NaN / Infinity replaced by null (the same words inside strings stay).

    One pass cuts the text into string literals and what stands between them; only the latter is changed.
    """
    pieces = F.regexp_extract_all(column, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"|[^"]++|"'), F.lit(0))
    bare = r"-?\b(?:NaN|Infinity)\b"
    changed = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(F.regexp_replace(p, bare, "null")))
    return F.array_join(changed, "")


def json_or_raw(column: Column) -> Column:
    """JSON object text; anything else is kept under ``raw``; no value gives ``{}``."""
    text = clean_text(column)
    parsed = F.try_parse_json(finite_json(text))
    is_object = F.startswith(text, F.lit("{")) & parsed.isNotNull()
    wrapped = F.when(parsed.isNotNull(), F.to_json(F.struct(parsed.alias("raw")))).otherwise(
        F.to_json(F.struct(text.alias("raw")))
    )
    return F.when(text.isNull(), F.lit("{}")).when(is_object, F.to_json(parsed)).otherwise(wrapped)


def brand_name(brand: Column, metadata: Column) -> Column:
    """The brand column, else ``metadata.brand``."""
    nested = clean_text(F.get_json_object(metadata, "$.brand"))
    return F.substring(F.coalesce(clean_text(brand), nested), 1, fixed.BRAND_LENGTH)


def weight_grams(value: Column, product_name: Column) -> Column:
    """Weight in grams: a mass in the name wins, a volume in the name means unknown."""
    pattern = "(?i)" + unicode_pattern(fixed.WEIGHT_PATTERN)
    amount = F.regexp_replace(F.regexp_extract(product_name, pattern, 1), ",", ".").try_cast("double")
    unit = F.lower(F.regexp_extract(product_name, pattern, 2))
    grams = F.lit(None).cast("double")
    for name, factor in fixed.MASS_UNITS.items():
        grams = F.when(unit == name, amount * F.lit(factor)).otherwise(grams)
    from_name = F.bround(grams, 2).cast("decimal(18,2)")
    return (
        F.when(unit.isin(*fixed.MASS_UNITS), from_name)
        .when(unit.isin(*fixed.VOLUME_UNITS), F.lit(None).cast("decimal(18,2)"))
        .otherwise(clean_number(value, 2))
    )


def category_path(parent: Column, name: Column) -> Column:
    """Path from the root: ``parent > name``."""
    return F.concat_ws(fixed.PATH_SEPARATOR, nonempty(stripped(parent)), name)


def path_leaf(path: Column) -> Column:
    """Last element of a path."""
    return F.element_at(F.split(path, fixed.PATH_SEPARATOR), -1)


def path_depth(path: Column) -> Column:
    """Number of ancestors in a path."""
    return F.size(F.split(path, fixed.PATH_SEPARATOR)) - 1


def identity_key(kind: Column, group: Column, code: Column, name: Column, raw_kind: str, prefix: str) -> Column:
    """``prefix:group:code:name``; kinds other than the raw one are added to the prefix."""
    head = F.when(kind == raw_kind, F.lit(prefix)).otherwise(F.concat(F.lit(prefix + "-"), kind))
    return F.concat_ws(":", head, group, code, name)


def compact_map(column: Column) -> Column:
    """Map without its NULL values."""
    return F.map_filter(column, lambda _, v: v.isNotNull())


def merge_maps(old: Column, new: Column) -> Column:
    """Shallow merge, the new side wins; a NULL side counts as empty."""
    merged = F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))
    return F.coalesce(merged, new, old)


def merge_json(old: Column, new: Column) -> Column:
    """Shallow merge of two flat JSON objects, the new side wins."""
    def as_map(c: Column) -> Column:
        return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))

    return F.to_json(merge_maps(as_map(old), as_map(new)))


def merged_aliases(old: Column, new: Column) -> Column:
    """Sorted distinct union of two alias lists without blanks."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(old, empty), F.coalesce(new, empty))
    return F.array_sort(F.array_distinct(F.filter(both, lambda a: F.trim(a) != "")))


def sql_literal(column: Column, kind: str) -> Column:
    """SQL literal text. Text with control characters or backslashes is refused."""
    if kind == "text":
        refused = column.rlike(r"[\x00-\x1f\\]")
        quoted = F.concat(F.lit("'"), F.replace(column, F.lit("'"), F.lit("''")), F.lit("'"))
        literal = F.when(refused, F.raise_error(F.lit("text not allowed in an export"))).otherwise(quoted)
    elif kind == "boolean":
        literal = F.when(column, "TRUE").otherwise("FALSE")
    else:
        literal = column.cast("string")
    return F.when(column.isNull(), F.lit("NULL")).otherwise(literal)
