"""Lines of text files with their place, also where a file is split over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of every line; ``line_no`` counts from 1 within its file, blank lines included.

    Lines keep their order within the byte range that a task reads. One pass counts the lines of each range, a running sum
    over the ranges of a file (one row each) gives what comes before, and the second pass adds the place in the range. No
    line moves, and no file is read by one task only.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"),
        "value",
    )
    ranges = lines.groupBy("file", "__start").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranges.select("file", "__start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("__shift"))
    return lines.join(shift, ["file", "__start"]).select("file", (F.col("__at") + F.col("__shift")).alias("line_no"), "value")


def broken_line(file: str = "file", line_no: str = "line_no") -> Column:
    """``name:number`` of a line, as messages cite it."""
    return F.concat_ws(":", F.element_at(F.split(file, "/"), -1), line_no)
