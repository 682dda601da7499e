"""Request and result files exchanged with outside services, and reviewed configuration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mealgrid.core.numbering import global_row_number
from mealgrid.core.scratch import durable
from mealgrid.sources.lines import numbered_lines

CHARACTERS_PER_TOKEN = 2.5
BLOCK_ROWS = 50_000


def estimated_tokens(text: Column) -> Column:
    """Rough token count of a request."""
    return (F.floor(F.length(text) / F.lit(CHARACTERS_PER_TOKEN)) + 1).cast("bigint")


def request_rejects(requests: DataFrame, max_tokens: int) -> DataFrame:
    """(custom_id, reason): requests that no part can hold, and ids that are there more than once."""
    long = requests.filter(estimated_tokens(F.col("text")) > max_tokens)
    repeated = requests.groupBy("custom_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return long.select("custom_id", F.lit("over the token limit").alias("reason")).unionByName(
        repeated.select("custom_id", F.lit("repeated id").alias("reason"))
    )


def request_parts(requests: DataFrame, order: list[str], max_rows: int, max_tokens: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Requests with ``part_no``: one greedy pass over the consecutive requests, bounded by rows and estimated tokens.

    Requests are numbered by range and looked at in blocks of ``block`` rows, each with the first ``max_rows`` rows of the
    next one. Where a part starts, the next start follows from the rows alone; a block therefore maps each of its first rows,
    if a part starts there, to a first row of the next block. These links are followed from the first row by doubling,
    and then every block knows where its first part starts. The parts do not depend on the block size. Requests over the
    token bound stand alone in no part: see ``request_rejects``.
    """
    tokens = estimated_tokens(F.col("text"))
    numbered = global_row_number(
        requests.withColumn("tokens", tokens).filter(F.col("tokens") <= max_tokens), [F.col(c).asc() for c in order]
    )
    block = max(block, max_rows)
    own = F.floor((F.col("row_no") - 1) / block)
    ahead = F.when((F.col("row_no") - 1) % block < max_rows, own - 1)
    slim = numbered.select("row_no", "tokens", F.explode(F.array_compact(F.array(own, ahead))).alias("block")).filter("block >= 0")

    def following(rows: pd.DataFrame) -> pd.DataFrame:
        """Rows in order with ``next``: the row at which the next part starts if one starts here."""
        rows = rows.sort_values("row_no", ignore_index=True)
        total = np.append(0, rows["tokens"].cumsum())
        at = np.arange(len(rows))
        reach = np.searchsorted(total, total[:-1] + max_tokens, side="right") - 1
        rows["next"] = np.minimum(reach, at + max_rows)
        return rows

    def crossings(rows: pd.DataFrame) -> pd.DataFrame:
        rows = following(rows)
        first = rows["block"].iloc[0] * block + 1
        size = int((rows["row_no"] < first + block).sum())
        leave = rows["next"].to_numpy().copy()
        for k in range(size - 1, -1, -1):
            if leave[k] < size:
                leave[k] = leave[leave[k]]
        entry = np.arange(min(max_rows, size))
        return pd.DataFrame({"a": first + entry, "b": first + leave[entry]})

    links = durable(slim.groupBy("block").applyInPandas(crossings, "a bigint, b bigint"))
    reached = durable(numbered.filter("row_no = 1").select("row_no"))
    while True:
        further = reached.join(links, reached["row_no"] == links["a"]).select(F.col("b").alias("row_no"))
        more = durable(reached.union(further).distinct())
        if more.count() == reached.count():
            break
        reached = more
        onward = links.select(F.col("a").alias("b"), F.col("b").alias("c"))
        links = durable(links.join(onward, "b").select("a", F.col("c").alias("b")))

    entries = reached.withColumn("block", F.floor((F.col("row_no") - 1) / block)).groupBy("block").agg(F.min("row_no").alias("entry"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = following(rows)
        first = rows["block"].iloc[0] * block + 1
        size = int((rows["row_no"] < first + block).sum())
        starts, at = np.zeros(size, np.int64), int(rows["entry"].iloc[0] - first)
        steps = rows["next"].to_numpy()
        while at < size:
            starts[at] = 1
            at = steps[at]
        return pd.DataFrame({"block": rows["block"][:size], "row_no": rows["row_no"][:size], "started": starts.cumsum()})

    # a part that began in the block before may fill a block to its end: then none starts in it
    placed = slim.join(entries, "block", "left").withColumn("entry", F.coalesce("entry", (F.col("block") + 1) * block + 1))
    filled = placed.groupBy("block").applyInPandas(fill, "block bigint, row_no bigint, started bigint")
    sizes = filled.groupBy("block").agg(F.max("started").alias("parts"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("block", F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("offset"))
    numbers = filled.join(offsets, "block").select("row_no", (F.col("offset") + F.col("started")).alias("part_no"))
    return numbered.join(numbers, "row_no")


def write_request_parts(parts: DataFrame, path: str) -> None:
    """One folder per part."""
    parts.write.mode("overwrite").partitionBy("part_no").json(path)


def classified_results(lines: DataFrame) -> DataFrame:
    """Response lines (``value``) with custom_id, ``reason`` (NULL when usable) and ``content``.

    The first failing test, from the outside in, is the reason.
    """
    doc = F.try_parse_json("value")

    def at(path: str) -> Column:
        return F.try_variant_get(doc, path, "variant")

    def text(path: str) -> Column:
        return F.try_variant_get(doc, path, "string")

    def kind(path: str) -> Column:
        return F.schema_of_variant(at(path))

    def is_kind(path: str, prefix: str) -> Column:
        return F.coalesce(F.startswith(kind(path), F.lit(prefix)), F.lit(False))

    def truthy(path: str) -> Column:
        empty = F.coalesce(F.to_json(at(path)), F.lit("null")).isin("null", '""', "{}", "[]", "0", "false")
        return ~empty

    message = "$.response.body.choices[0].message"
    reason = (
        F.when(doc.isNull(), "bad_line")
        .when(truthy("$.error"), "batch_error")
        .when(~is_kind("$.response", "OBJECT"), "missing_response")
        .when(F.coalesce(text("$.response.status_code"), F.lit("")) != "200", "http_error")
        .when(~is_kind("$.response.body", "OBJECT"), "missing_body")
        .when(~is_kind("$.response.body.choices[0]", "OBJECT"), "empty_choices")
        .when(at(message).isNotNull() & ~is_kind(message, "OBJECT"), "bad_message")
        .when(truthy(message + ".refusal"), "refusal")
        .when(
            ~is_kind(message + ".content", "STRING") | (F.trim(F.coalesce(text(message + ".content"), F.lit(""))) == ""),
            "empty_content",
        )
    )
    return lines.select(
        F.coalesce(text("$.custom_id"), F.lit("<unknown>")).alias("custom_id"),
        reason.alias("reason"),
        F.when(reason.isNull(), text(message + ".content")).alias("content"),
    )


def parsed_results(classified: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records with the payload fields, failures): content that does not fit the schema fails too."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    checked = classified.withColumn("record", F.from_json("content", f"{schema}, _corrupt STRING", options)).withColumn(
        "reason",
        F.coalesce("reason", F.when(F.col("record._corrupt").isNotNull(), "schema_validation")),
    )
    good = checked.filter(F.col("reason").isNull()).select("custom_id", "record.*").drop("_corrupt")
    return good, checked.filter(F.col("reason").isNotNull()).select("custom_id", "reason")


def read_cases(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(cases, broken lines with file and line_no) of case files; blank lines and ``//`` comments are skipped.

    Files without a single case line are an error.
    """

    def case_lines(lines: DataFrame) -> DataFrame:
        return lines.filter((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("//")))

    plain = case_lines(spark.read.text(path))
    if plain.isEmpty():
        raise ValueError(f"{path}: no cases")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    record = F.from_json("value", f"{schema}, _corrupt STRING", options)
    broken = F.col("r._corrupt").isNotNull()
    cases = plain.withColumn("r", record).filter(~broken).select("r.*").drop("_corrupt")
    told = case_lines(numbered_lines(spark, path)).withColumn("r", record).filter(broken)
    return cases, told.select("file", "line_no", F.col("value").alias("line"))


def read_experiment(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Case rows of result files; the metadata line (no case id) is left out."""
    return spark.read.schema(schema).json(path).filter(F.col("case_id").isNotNull())


def review_list(column: Column) -> Column:
    """Bar-separated list of a reviewed configuration file; empty entries are dropped."""
    return F.filter(F.split(column, r"\|"), lambda v: v != "")


def with_allowed_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Configuration whose column may only hold listed values; anything else is an error."""
    unknown = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column)))
    return df.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(unknown))


def write_staging(df: DataFrame, path: str) -> None:
    """Replace a staging table; columns are bound by name."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Decision or rejection report as JSON lines."""
    df.write.mode("overwrite").json(path)


def name_records(lines: DataFrame) -> DataFrame:
    """Recipes in the record shape the name resolution reads.

    ``lines`` has recipe_id, recipe_name, line_no, name and quantity; one array holds the lines of
    one recipe text.
    """
    raw = F.trim(F.concat_ws(" ", "name", "quantity"))
    entry = F.struct("line_no", raw.alias("raw_text"), F.col("name"), F.col("name").alias("normalized_name"))
    return (
        lines.groupBy("recipe_id", "recipe_name")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(
            F.col("recipe_id").cast("string").alias("source_recipe_id"),
            F.col("recipe_name").alias("name"),
            F.transform("entries", lambda e: F.struct(e["raw_text"], e["name"], e["normalized_name"])).alias(
                "ingredients"
            ),
        )
    )
