"""Chat formatting: turns become one marked text per conversation, by Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn, role, text), nulls last; adjacent turns of
one role become one block by array aggregation; blocks are concatenated. A block is::

    <|turn|>role<|text|>text<|part|>text<|end|>\\n

with ``<|part|>`` between the texts of merged turns, so that nothing is lost. Control strings (those of this template
and of other common ones) inside roles and texts are escaped: backslashes are doubled, and a backslash follows the first
character of each control string. Undoing that is one replacement, so reading back returns the turns exactly.

``loss`` lists the (start, length) code point ranges of the assistant's texts in the formatted text.

Null roles and texts count as empty. Rows with a null conversation id form one conversation. Repeated rows are repeated
turns. A conversation is one output row, hence one group; there is no bound on its length but that of a text.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.llm.common import let

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
LEARNED_ROLE = "assistant"
#: First character and rest of control strings: any <|name|>, sentence marks and instruction marks.
CONTROL = r"(<)(?=\|[A-Za-z0-9_]*\|>|/?s>|</?SYS>>)|(\[)(?=/?INST\])"


def escaped(text: Column) -> Column:
    """The text without control strings."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$2\\")


def unescaped(text: Column) -> Column:
    """The text before ``escaped``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: id, ``formatted`` and ``loss``."""
    turn = F.struct(
        F.col(turn_col).isNull().alias("none"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("__turns"))

    def blocks(sorted_turns: Column) -> Column:
        """Runs of one role: where they start, and the turns up to the next start."""
        starts = F.filter(
            F.sequence(F.lit(0), F.size(sorted_turns) - 1),
            lambda i: (i == 0) | (F.get(sorted_turns, i)["role"] != F.get(sorted_turns, F.greatest(i - 1, F.lit(0)))["role"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(sorted_turns, at)["role"].alias("role"),
                    F.transform(
                        F.slice(sorted_turns, at + 1, F.coalesce(F.get(s, k + 1), F.size(sorted_turns)) - at),
                        lambda t: escaped(t["text"]),
                    ).alias("texts"),
                ),
            ),
        )

    def pieces(block: Column) -> Column:
        """Header, texts with separators, and footer; each with its share in the loss."""
        learned = block["role"] == F.lit(LEARNED_ROLE)
        plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        body = F.transform(
            block["texts"],
            lambda text, i: F.array(
                plain(F.when(i == 0, F.lit("")).otherwise(F.lit(PART))),
                F.struct(text.alias("text"), learned.alias("loss")),
            ),
        )
        header = F.concat(F.lit(TURN), escaped(block["role"]), F.lit(TEXT))
        return F.concat(F.array(plain(header)), F.flatten(body), F.array(plain(F.lit(f"{END}\n"))))

    listed = turns.select(id_col, blocks(F.col("__turns")).alias("__blocks")).select(
        id_col, F.flatten(F.transform("__blocks", pieces)).alias("__pieces")
    )
    begin = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")
    )

    def step(state: Column, piece: Column) -> Column:
        size = F.length(piece["text"])
        span = F.struct(state["at"].alias("start"), size.alias("length"))
        spans = F.when(piece["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), spans.alias("spans"))

    return listed.select(
        id_col,
        F.array_join(F.transform("__pieces", lambda p: p["text"]), "").alias("formatted"),
        F.aggregate("__pieces", begin, step, lambda state: state["spans"]).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text was made of."""
    parts = F.split(formatted, r"<\|turn\|>", -1)
    blocks = F.filter(parts, lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        body = F.regexp_replace(block, r"<\|end\|>\n$", "")
        role = F.substring_index(body, TEXT, 1)
        texts = F.split(F.substring(body, F.length(role) + len(TEXT) + 1, F.length(body)), r"<\|part\|>", -1)
        return let(
            F.struct(unescaped(role).alias("role"), texts.alias("texts")),
            lambda b: F.transform(
                b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text"))
            ),
        )

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Counts and digests, all read back from the formatted text and its loss ranges."""
    loss = F.array_join(
        F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), ""
    )
    read = formatted.select(
        id_col, read_back(F.col("formatted")).alias("__turns"), loss.alias("__loss"), F.length("formatted").alias("__n")
    )
    said = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        id_col,
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.col("__n").cast("long").alias("formatted_chars"),
    )
