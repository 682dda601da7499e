"""Recipe texts: ingredient lines, quantities, steps and cooking methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.text import match_key, nonempty, stripped, unicode_pattern


def cooking_method(column: Column) -> Column:
    """First part of the text that names a known method decides; NULL when none does."""

    def method_of(part: Column) -> Column:
        rules = F.lit(None).cast("string")
        for word, method in reversed(fixed.METHOD_WORDS):
            rules = F.when(F.contains(part, F.lit(word)), F.lit(method)).otherwise(rules)
        return rules

    parts = F.split(column, fixed.METHOD_SEPARATORS)
    return F.try_element_at(F.filter(F.transform(parts, method_of), lambda m: m.isNotNull()), F.lit(1))


def clean_step(column: Column) -> Column:
    """Step text without its leading number and the stray letter after the last full stop."""
    without_number = F.regexp_replace(column, unicode_pattern(fixed.STEP_NUMBER), "")
    return stripped(F.regexp_replace(without_number, fixed.STEP_MARK, ""))


def ingredient_items(column: Column) -> Column:
    """Array of (name, quantity) in text order, repeated names included."""

    def section_items(section: Column) -> Column:
        body = stripped(F.regexp_replace(section, unicode_pattern(fixed.PORTION_HEAD), ""))
        body = stripped(F.regexp_replace(body, unicode_pattern(fixed.SECTION_TITLE), ""))
        parts = F.filter(F.transform(F.split(body, ","), stripped), lambda p: p != "")
        return F.transform(parts, item)

    def item(part: Column) -> Column:
        pattern = unicode_pattern(fixed.ITEM_NAME)
        matched = part.rlike(pattern)
        name = F.when(matched, F.regexp_extract(part, pattern, 1)).otherwise(part)
        quantity = F.when(matched, stripped(F.regexp_extract(part, pattern, 2))).otherwise("")
        name = stripped(F.regexp_replace(stripped(name), unicode_pattern(fixed.STATE_TAIL), ""))
        return F.struct(name.alias("name"), quantity.alias("quantity"))

    lines = F.split(F.regexp_replace(column, fixed.HTML_TAG, "\n"), fixed.SECTION_MARKS)
    sections = F.filter(F.transform(lines, stripped), lambda s: (s != "") & ~s.rlike("[:：]$"))
    items = F.flatten(F.transform(sections, section_items))
    return F.filter(items, lambda i: (i["name"] != "") & ~i["name"].rlike(unicode_pattern(r"^\d")))


def parse_ingredient_lines(recipes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, name, quantity, match_key): the first line of every distinct name of a recipe.

    Repeats are removed by a partial + final minimum over the position. Lines are then renumbered;
    a numbering group holds only the lines of one recipe text, which came from a single row.
    """
    lines = recipes.select(key, F.posexplode(ingredient_items(F.col(text))).alias("pos", "item")).select(
        key, "pos", "item.name", "item.quantity"
    )
    first = (
        lines.withColumn("match_key", match_key(F.col("name")))
        .groupBy(key, "match_key")
        .agg(F.min(F.struct("pos", "name", "quantity")).alias("first"))
        .select(key, "match_key", "first.*")
    )
    line_no = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return first.withColumn("line_no", line_no).drop("pos")


def match_candidates(column: Column) -> Column:
    """Spellings to try for a name, best first: as is, without preparation words, oil variants."""

    def bare(c: Column) -> Column:
        return stripped(F.regexp_replace(c, unicode_pattern(fixed.PREP_PREFIX), ""))

    name = stripped(column)
    no_suffix = stripped(F.regexp_replace(name, unicode_pattern(fixed.PREP_SUFFIX), ""))
    spellings = F.array_distinct(F.filter(F.array(name, no_suffix, bare(name), bare(no_suffix)), lambda c: c != ""))
    oils = F.transform(
        F.filter(spellings, lambda c: c.endswith(fixed.OIL_LONG)),
        lambda c: F.regexp_replace(c, fixed.OIL_LONG + "$", fixed.OIL_SHORT),
    )
    return F.array_distinct(F.concat(spellings, oils))


def quantity_value(column: Column) -> Column:
    """Number in a quantity text: mixed number, fraction or decimal plus fraction signs, two places.

    NULL when there is no number or a denominator is zero.
    """
    text = stripped(column)
    signs = F.lit(0.0)
    has_sign = F.lit(False)
    rest = text
    for sign, (top, bottom) in fixed.FRACTION_SIGNS.items():
        present = F.contains(text, F.lit(sign))
        signs = signs + F.when(present, F.lit(top / bottom)).otherwise(0.0)
        has_sign = has_sign | present
        rest = F.replace(rest, F.lit(sign), F.lit(" "))
    rest = F.ltrim(rest)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(rest, unicode_pattern(pattern), group).try_cast("double")

    def is_like(pattern: str) -> Column:
        return rest.rlike(unicode_pattern(pattern))

    mixed = part(fixed.MIXED_NUMBER, 1) + F.try_divide(part(fixed.MIXED_NUMBER, 2), part(fixed.MIXED_NUMBER, 3))
    fraction = F.try_divide(part(fixed.FRACTION, 1), part(fixed.FRACTION, 2))
    number = (
        F.when(is_like(fixed.MIXED_NUMBER), mixed)
        .when(is_like(fixed.FRACTION), fraction)
        .when(is_like(fixed.PLAIN_NUMBER), part(fixed.PLAIN_NUMBER, 1))
        .when(has_sign, F.lit(0.0))
    )
    return F.bround(signs + number, 2)


def quantity_unit(column: Column) -> Column:
    """What is left of a quantity without digits, fraction signs and blanks (30 characters)."""
    return nonempty(F.substring(F.regexp_replace(column, unicode_pattern(fixed.UNIT_NOISE), ""), 1, 30))
