"""Counts and ratios that describe a load, a catalog or an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.functions import fixed_values as fixed


def master_report(ingredient: DataFrame) -> DataFrame:
    """Raw and processed ingredients, aliases and pantry staples."""
    aliases = F.coalesce(F.size("aliases"), F.lit(0))
    return ingredient.agg(
        F.count_if("is_raw_material").alias("raw"),
        F.count_if(~F.col("is_raw_material")).alias("processed"),
        F.count_if(aliases > 0).alias("with_alias"),
        F.sum(aliases).alias("alias_total"),
        F.count_if("is_pantry").alias("pantry"),
    )


def frequent_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.orderBy(F.col("occurrences").desc(), F.col(column).asc()).limit(n)


def match_summary(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """Lines, lines with a matched ``name``, their share, and the number of distinct names without a match.

    Lines are counted per name first, so nothing is counted distinct in one task.
    """
    known = matched.select("name").distinct().withColumn("known", F.lit(True))
    names = lines.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(known, "name", "left")
    total, hit = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    return names.agg(
        total.alias("lines"),
        hit.alias("matched_lines"),
        (hit / F.nullif(total, F.lit(0))).alias("match_rate"),
        F.count_if(F.col("known").isNull()).alias("unmatched_names"),
    )


def covered_products(product: DataFrame, links: DataFrame) -> DataFrame:
    """Share of products with at least one ingredient.

    Links are reduced to one row per product first, so nothing is counted distinct in one task.
    """
    linked = links.select("product_id").distinct().withColumn("linked", F.lit(1))
    return product.join(linked, "product_id", "left").agg(
        F.count("linked").alias("covered"),
        F.count(F.lit(1)).alias("products"),
        (F.count("linked") / F.count(F.lit(1))).alias("coverage"),
    )


def unknown_labels(df: DataFrame, raw: str, mapped: Column) -> DataFrame:
    """Raw labels that map to nothing, with counts."""
    return (
        df.filter(F.col(raw).isNotNull() & mapped.isNull())
        .groupBy(raw)
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def source_list(df: DataFrame, column: str) -> DataFrame:
    """Distinct values joined by a comma (for columns with few values, such as source types)."""
    values = df.select(column).distinct()
    return values.agg(F.array_join(F.array_sort(F.collect_set(column)), ", ").alias("sources"))


def token_estimate(df: DataFrame, column: str) -> DataFrame:
    """Half the total number of characters."""
    return df.agg(F.floor(F.sum(F.length(column)) / 2).alias("tokens"))


def category_rows(paths: DataFrame, column: str) -> DataFrame:
    """Distinct top and leaf categories of two-level paths with parent, name and depth."""
    parts = F.split(column, fixed.PATH_SEPARATOR, 2)
    top = F.struct(parts[0].alias("path"), F.lit("").alias("parent_path"), parts[0].alias("name"), F.lit(0).alias("depth"))
    leaf = F.struct(F.col(column).alias("path"), parts[0].alias("parent_path"), parts[1].alias("name"), F.lit(1).alias("depth"))
    return (
        paths.filter(F.col(column) != "")
        .select(F.explode(F.array(top, leaf)).alias("c"))
        .select("c.*")
        .distinct()
    )


def ratio_label(hits: Column, known: Column) -> Column:
    """``k/n (p %)`` over known values."""
    percent = F.bround(hits * 100 / known, 0).cast("int")
    return F.format_string("%d/%d (%d %%)", hits, known, percent)


def nutrition_master(rows: DataFrame, alias_columns: list[str], key: Column) -> DataFrame:
    """One master row per (kind, group, code, name) with its alias list and the group's first name.

    ``key`` is the match spelling of a column ``alias``; aliases equal to the name are left out.
    """
    group_names = rows.groupBy("kind", "group").agg(F.min_by("group_name", "row_no").alias("group_name"))
    aliases = (
        rows.select("kind", "group", "code", "name", F.explode(F.array(*alias_columns)).alias("alias"))
        .filter(F.col("alias").isNotNull() & (key != F.lower(F.regexp_replace("name", r"(?U)\s+", ""))))
        .distinct()
        .groupBy("kind", "group", "code", "name")
        .agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    )
    heads = rows.select("kind", "group", "code", "name").distinct()
    return (
        heads.join(aliases, ["kind", "group", "code", "name"], "left")
        .join(group_names, ["kind", "group"], "left")
        .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    )


def rubric_metrics(scored: DataFrame) -> DataFrame:
    """Scored and unscored rows, mean score and share at or above the pass mark (over scored rows)."""
    good = F.col("mean").isNotNull()
    return scored.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(good).alias("scored"),
        F.count_if(~good).alias("unscored"),
        F.avg("mean").alias("mean_score"),
        F.try_divide(F.count_if(F.col("passed")), F.count_if(good)).alias("judge_pass_rate"),
    )


def rubric_item_means(scored: DataFrame) -> DataFrame:
    """Mean per rubric item over scored rows."""
    return (
        scored.filter(F.col("mean").isNotNull())
        .select(F.explode("scores").alias("item", "score"))
        .groupBy("item")
        .agg(F.avg("score").alias("mean"))
    )


def check_metrics(checked: DataFrame, text: str) -> DataFrame:
    """Share of texts passing all checks, and of distinct texts.

    Distinct texts are counted after a reduction by hash, so no text travels more than once per task.
    """
    per_text = checked.groupBy(F.sha2(text, 256).alias("digest")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("failed") == 0).alias("good")
    )
    return per_text.agg(
        (F.sum("good") / F.sum("n")).alias("check_pass_rate"),
        (F.count(F.lit(1)) / F.sum("n")).alias("distinct_ratio"),
    )


def failure_counts(checked: DataFrame) -> DataFrame:
    """How often each check failed."""
    return (
        checked.select(F.explode_outer("failed").alias("name"))
        .filter(F.col("name").isNotNull())
        .groupBy("name").agg(F.count(F.lit(1)).alias("failures"))
    )


def attack_summary(trials: DataFrame) -> DataFrame:
    """Per attack: trials and the shares followed, served and passed, with the mean score."""
    n = F.count(F.lit(1))
    return trials.groupBy("attack_id").agg(
        n.alias("trials"),
        (F.count_if("followed") / n).alias("follow_ratio"),
        (F.count_if("served") / n).alias("serve_ratio"),
        (F.count_if("passed") / n).alias("pass_ratio"),
        F.avg("score").alias("mean_score"),
    )


PAIR_GAP = 0.2


def pair_comparison(outputs: DataFrame) -> DataFrame:
    """A and B sides of each pair next to each other: score and length gaps, check mismatch, flag."""
    sides = outputs.groupBy("pair_id", "axis").pivot("side", ["A", "B"]).agg(
        F.max("score").alias("score"), F.max(F.length("text")).alias("length"), F.bool_and("passed").alias("passed")
    )
    gap = F.abs(F.col("A_score") - F.col("B_score"))
    mismatch = F.col("A_passed") != F.col("B_passed")
    return (
        sides.filter(F.col("A_length").isNotNull() & F.col("B_length").isNotNull())
        .withColumn("score_gap", gap)
        .withColumn("length_gap", F.abs(F.col("A_length") - F.col("B_length")))
        .withColumn("check_mismatch", mismatch)
        .withColumn("flagged", F.coalesce(gap >= PAIR_GAP, F.lit(False)) | mismatch)
    )


def ratio_summary(rows: DataFrame, items: dict[str, Column]) -> DataFrame:
    """(item, result): ``k/n (p %)`` per flag over the rows where it is known."""
    counts = rows.agg(
        *[F.count_if(flag).alias(f"{name}_hits") for name, flag in items.items()],
        *[F.count(flag).alias(f"{name}_known") for name, flag in items.items()],
    )
    entries = [
        F.struct(
            F.lit(name).alias("item"), ratio_label(F.col(f"{name}_hits"), F.col(f"{name}_known")).alias("result")
        )
        for name in items
    ]
    return counts.select(F.explode(F.array(*entries)).alias("x")).select("x.item", "x.result")


def route_metrics(results: DataFrame) -> DataFrame:
    """Route accuracy and hit rate over the cases that expect something, and the mean latency."""
    return results.agg(
        F.avg(F.when(F.col("expected_route").isNotNull(), (F.col("route") == F.col("expected_route")).cast("int"))).alias(
            "route_accuracy"
        ),
        F.avg(F.when(F.col("hit").isNotNull(), F.col("hit").cast("int"))).alias("hit_rate"),
        F.avg("elapsed_ms").alias("mean_latency_ms"),
    )
