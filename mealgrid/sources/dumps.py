"""Database dump text in, portable INSERT text out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mealgrid.core.numbering import global_row_number
from mealgrid.functions.catalog_values import sql_literal

COPY_START = r"^COPY public\.(\w+) \(([^)]*)\)"
COPY_END = "\\."
ROWS_PER_STATEMENT = 200
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", "v": "\x0b"}


def _dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a position: file, split start, then reading order inside the split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")
        ).alias("pos"),
        "value",
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, table, column_list, start, end) of every COPY block; ``end`` is NULL in a cut-off file.

    Only the marker lines, two per table, go through the per-file window. A start marker inside an
    open block is data and does not count.
    """
    is_end = F.startswith("value", F.lit(COPY_END))
    name = F.regexp_extract("value", COPY_START, 1)
    markers = lines.filter(is_end | (name != "")).withColumn("is_end", is_end)
    in_file = Window.partitionBy("file").orderBy("pos")
    starts = (
        markers.withColumn("after_end", F.coalesce(F.lag("is_end").over(in_file), F.lit(True)))
        .filter(F.col("is_end") | F.col("after_end"))
        .withColumn("next_is_end", F.lead("is_end").over(in_file))
        .withColumn("next_pos", F.lead("pos").over(in_file))
    )
    return starts.filter(~F.col("is_end")).select(
        "file",
        name.alias("table_name"),
        F.regexp_extract("value", COPY_START, 2).alias("column_list"),
        F.col("pos").alias("start"),
        F.when(F.col("next_is_end"), F.col("next_pos")).alias("end"),
    )


def copy_field(raw: Column) -> Column:
    r"""Decoded field: ``\N`` is NULL; backslash escapes are resolved once, left to right.

    The text is cut at double backslashes first, so what follows one is never read as an escape.
    """

    def unescape(piece: Column) -> Column:
        for letter, char in _ESCAPES.items():
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(char))
        return piece

    decoded = F.array_join(F.transform(F.split(raw, r"\\\\"), unescape), "\\")
    return F.when(raw != "\\N", decoded)


def read_copy_dump(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """Rows of one table's COPY block as text columns; a missing or cut-off block is an error."""
    lines = _dump_lines(spark, path)
    blocks = _blocks(lines).filter(F.col("table_name") == table)
    found = blocks.select(F.count(F.lit(1)).alias("n")).scalar()
    complete = F.when(F.col("end").isNull(), F.raise_error(F.lit(f"{table}: COPY block is cut off"))).otherwise(
        F.col("end")
    )
    present = F.when(found == 0, F.raise_error(F.lit(f"{table}: no COPY block in the dump")))
    intervals = blocks.withColumn("end", complete)
    names = F.split("column_list", ", ")
    fields = F.split("value", "\t", -1)
    width = F.when(F.size(fields) != F.size(names), F.raise_error(F.lit(f"{table}: wrong number of fields")))
    inside = (
        lines.join(intervals, "file")
        .filter((F.col("pos") > F.col("start")) & (F.col("pos") < F.col("end")))
        .withColumn("fields", F.coalesce(width, fields))
        .withColumn("row", F.map_from_arrays(names, "fields"))
    )
    picked = [copy_field(F.col("row")[c]).alias(c) for c in columns]
    nothing = spark.range(1).select(present.alias("p")).filter(F.col("p").isNotNull())
    empty = nothing.select(*[F.lit(None).cast("string").alias(c) for c in columns])
    return inside.select(*picked).unionByName(empty)


def export_insert_sql(df: DataFrame, table: str, columns: Mapping[str, str], order: list[str]) -> DataFrame:
    """(statement_no, statement): multi-row INSERT text in the given order.

    ``columns`` maps names to literal kinds (text, number, boolean). Rows are numbered by range, and
    each statement gathers ``ROWS_PER_STATEMENT`` rows.
    """
    literals = F.concat(F.lit("  ("), F.concat_ws(", ", *[sql_literal(F.col(c), k) for c, k in columns.items()]), F.lit(")"))
    rows = df.select(*order, literals.alias("row"))
    numbered = global_row_number(rows, [F.col(c).asc() for c in order])
    header = f"INSERT INTO {table} ({', '.join(columns)}) VALUES\n"
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row"))), lambda r: r["row"]), ",\n"
    )
    return (
        numbered.withColumn("statement_no", F.floor((F.col("row_no") - 1) / ROWS_PER_STATEMENT))
        .groupBy("statement_no")
        .agg(F.concat(F.lit(header), body, F.lit(";")).alias("statement"))
    )


@dataclass(frozen=True)
class ExportTable:
    """A table to export: its rows, literal kinds of its columns, order of its rows, and the tables its keys refer to."""

    name: str
    rows: DataFrame
    columns: Mapping[str, str]
    order: Sequence[str]
    references: Sequence[str] = ()


def export_order(tables: Sequence[ExportTable]) -> list[ExportTable]:
    """Tables such that every one follows those it refers to; among the rest the given order stays.

    References to tables that are not exported, and to the table itself, do not count; a circle is an error.
    """
    names, out = {t.name for t in tables}, []
    waiting = list(tables)
    while waiting:
        done = {t.name for t in out}
        ready = [t for t in waiting if all(r in done or r not in names or r == t.name for r in t.references)]
        if not ready:
            raise ValueError("tables refer to each other in a circle: " + ", ".join(t.name for t in waiting))
        out.append(ready[0])
        waiting.remove(ready[0])
    return out


def export_tables(tables: Sequence[ExportTable]) -> DataFrame:
    """(statement_no, table, statement) of several tables in one script that can be run from first to last.

    Every table begins with a comment that states its number of rows; statement numbers run on from one table to the next.
    """
    script, at = None, 0
    for t in export_order(tables):
        count = t.rows.count()
        spark = t.rows.sparkSession
        comment = spark.range(1).select(F.lit(at).cast("long").alias("statement_no"), F.lit(f"-- {t.name}: {count} rows").alias("statement"))
        inserts = export_insert_sql(t.rows, t.name, t.columns, list(t.order))
        numbered = inserts.select((F.col("statement_no") + at + 1).alias("statement_no"), "statement")
        part = comment.unionByName(numbered).select("statement_no", F.lit(t.name).alias("table"), "statement")
        script = part if script is None else script.unionByName(part)
        at += 1 + -(-count // ROWS_PER_STATEMENT)
    return script
