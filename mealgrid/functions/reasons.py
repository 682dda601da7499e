"""Texts built from recommendation rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.text import object_particle


def template_reason(recipe: Column, have: Column, missing: Column) -> Column:
    """Rule text by the number of missing ingredients; names give way to counts beyond the limit."""
    count = F.size(missing)
    dish = F.concat(recipe, object_particle(recipe))
    first_have = F.try_element_at(have, F.lit(1))
    first_missing = F.try_element_at(missing, F.lit(1))

    short_one = F.concat(first_missing, F.lit("만 더하면 "), dish, F.lit(" 만들 수 있어요."))
    with_have = F.concat(first_have, object_particle(first_have), F.lit(" 활용하고 "), short_one)
    few_tail = F.concat(count.cast("string"), F.lit("가지를 더 준비하면 "), dish, F.lit(" 만들 수 있어요."))
    few_named = F.concat(F.array_join(F.slice(missing, 1, 2), "·"), F.lit(" 등 "), few_tail)
    few_counted = F.concat(F.lit("재료 "), few_tail)
    many = F.concat(
        recipe, F.lit("에 필요한 재료 "), count.cast("string"), F.lit("가지를 장보기 목록에서 확인해 보세요.")
    )
    fits = fixed.TEMPLATE_LIMIT
    return (
        F.when(count == 0, F.concat(dish, F.lit(" 바로 만들어 보세요.")))
        .when((count == 1) & first_have.isNotNull() & (F.length(with_have) <= fits), with_have)
        .when(count == 1, short_one)
        .when((count <= 3) & (F.length(few_named) <= fits), few_named)
        .when(count <= 3, few_counted)
        .otherwise(many)
    )


def _json_text(column: Column) -> Column:
    escaped = F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, safe in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _json_list(column: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(column), _json_text), ", "), F.lit("]"))


def case_fingerprint(
    recipe: Column, match_rate: Column, have: Column, missing: Column, pantry: Column, cook_time: Column, note: Column
) -> Column:
    """First 16 hex digits of SHA-256 over the canonical JSON of a situation (keys and lists sorted)."""
    digits = F.regexp_replace(F.bround(match_rate, 4).cast("decimal(10,4)").cast("string"), r"0+$", "")
    rate = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    pairs = [
        ("cook_time_min", F.coalesce(cook_time.cast("string"), F.lit("null"))),
        ("have", _json_list(have)),
        ("match_rate", rate),
        ("missing", _json_list(missing)),
        ("note", _json_text(note)),
        ("pantry", _json_list(pantry)),
        ("recipe", _json_text(recipe)),
    ]
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), value) for name, value in pairs])
    return F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 16)


def situation_text(
    recipe: Column, match_rate: Column, have: Column, missing: Column, pantry: Column, cook_time: Column, note: Column
) -> Column:
    """Labelled multi-line description of a situation; absent values are said to be absent."""

    def listed(c: Column) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(fixed.NONE_LISTED)

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    percent = F.concat(F.bround(match_rate * 100, 0).cast("int").cast("string"), F.lit("%"))
    minutes = F.when(F.coalesce(cook_time, F.lit(0)) != 0, F.concat(cook_time.cast("string"), F.lit("분"))).otherwise(
        fixed.TIME_UNKNOWN
    )
    staples = F.when(
        F.size(pantry) > 0, line("상비 재료(집에 있다고 보고 사라고 하지 말 것): ", F.array_join(pantry, ", "))
    )
    return F.concat_ws(
        "\n",
        line("레시피: ", recipe),
        line("재료 보유율: ", percent),
        line("가지고 있는 재료: ", listed(have)),
        line("부족한 재료: ", listed(missing)),
        staples,
        line("조리시간: ", minutes),
        F.when(note != "", line("비고: ", note)),
    )


def context_line(source: Column, doc_id: Column, title: Column, body: Column) -> Column:
    """``[source#id] title - body``; an empty body is left out."""
    head = F.concat(F.lit("["), source, F.lit("#"), doc_id.cast("string"), F.lit("] "), title)
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(head, F.lit(" - "), body)).otherwise(head)
