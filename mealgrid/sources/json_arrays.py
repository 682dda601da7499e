"""Records of JSON arrays that many tasks read, whatever the line breaks of a file.

A file is read as pieces that end at a closing brace, so byte ranges can be read apart. Whether a brace is part of a string, and
how deep it closes, depends on all text before it. Both are sums: the parity of quotes that are not escaped, and opened minus
closed brackets outside strings. Every range is measured once, for either state at its start; running sums over the ranges of a
file (one row each) tell which holds; and a record ends wherever the depth comes back to that of the array. Pieces are put
together by the number of records that ended before them, so a record may lie across ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mealgrid.core.scratch import written

_RANGE = ["file", "start"]


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _outside(text: Column, inside: bool) -> Column:
    """A piece and its closing brace without strings; ``inside`` says whether it begins in one."""
    whole = F.concat(F.lit('"' if inside else ""), text, F.lit("}"))
    return F.regexp_replace(whole, r'"[^"]*("|$)', "")


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pieces in order of (file, start, at), measured for a range that begins outside (0) or inside (1) a string."""
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    plain = read.withColumn("plain", F.regexp_replace("value", r"(?s)\\.", ""))  # no escapes, so every quote counts
    quoted = plain.withColumn("quotes", _count(F.col("plain"), '"'))
    before = Window.partitionBy(*_RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    told = quoted.withColumn("odd", odd)
    for state in (0, 1):
        is_in = F.col("odd") if state == 0 else ~F.col("odd")
        rest = F.when(is_in, _outside(F.col("plain"), True)).otherwise(_outside(F.col("plain"), False))
        told = told.withColumn(f"d{state}", _count(rest, "{[") - _count(rest, "}]")).withColumn(f"brace{state}", F.endswith(rest, F.lit("}")))
    return told.drop("plain", "odd")


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record_no, value): text of every object in the top-level array of each file; anything else in it is an error."""
    pieces = written(_pieces(spark, path), "json-pieces")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def before(column: Column) -> Column:
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    ranges = pieces.groupBy(*_RANGE).agg(F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    begun = ranges.withColumn("odd", before(F.col("quotes")) % 2 == 1)
    depth = F.when(F.col("odd"), F.col("d1")).otherwise(F.col("d0"))
    begun = begun.select(*_RANGE, "odd", before(depth).alias("depth"))
    within = Window.partitionBy(*_RANGE).orderBy("at")
    chosen = lambda name: F.when(F.col("odd"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    deep = pieces.join(begun, _RANGE).withColumn("after", F.col("depth") + F.sum(chosen("d")).over(within))
    ended = deep.select(*_RANGE, "at", "value", (chosen("brace") & (F.col("after") == 1)).alias("ends"))
    ended = written(ended, "json-ends")
    passed = ended.groupBy(*_RANGE).agg(F.count_if("ends").alias("n"))
    passed = passed.select(*_RANGE, before(F.col("n")).alias("passed"))
    done = F.coalesce(F.sum(F.col("ends").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ended.join(passed, _RANGE).withColumn("record_no", F.col("passed") + done + 1)
    parts = F.array_sort(F.collect_list(F.struct("start", "at", "value")))
    joined = numbered.groupBy("file", "record_no").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "}").alias("value"), F.max("ends").alias("ends")
    )
    return joined.select("file", "record_no", _record(F.col("value"), F.col("ends")).alias("value")).where("value IS NOT NULL")


def _record(text: Column, ends: Column) -> Column:
    """An object without what separates it from the one before, on one line; null for what follows the last one."""
    body = F.regexp_replace(text, r"^[﻿\s]*[\[,]?\s*", "")
    wrong = F.raise_error(F.concat(F.lit("records must be JSON objects: "), F.substring(text, 1, 80)))
    closing = F.regexp_replace(text, r"[﻿\s\[\]]", "") == ""
    record = F.when(F.startswith(body, F.lit("{")), F.translate(F.concat(body, F.lit("}")), "\r\n", "  ")).otherwise(wrong)
    return F.when(ends, record).when(~closing, wrong)
