"""General text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mealgrid.functions import fixed_values as fixed


def unicode_pattern(pattern: str) -> str:
    r"""Pattern whose ``\s``, ``\d``, ``\w`` and ``\b`` cover all of Unicode."""
    return "(?U)" + pattern


_EDGES = unicode_pattern(r"^\s+|\s+$")
_BLANKS = unicode_pattern(r"\s+")


def stripped(column: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(column, _EDGES, "")


def nonempty(column: Column) -> Column:
    """Empty text becomes NULL."""
    return F.nullif(column, F.lit(""))


def clean_text(column: Column) -> Column:
    """Trimmed text; the spellings of "no value" become NULL."""
    text = stripped(column.cast("string"))
    return F.when(~F.lower(text).isin(*fixed.EMPTY_WORDS), text)


def match_key(column: Column) -> Column:
    """Spelling used for name matching: no white space, lower case."""
    return F.lower(F.regexp_replace(column, _BLANKS, ""))


def cluster_key(column: Column) -> Column:
    """Spelling used for clusters: single blanks, trimmed, lower case."""
    return F.lower(stripped(F.regexp_replace(column, _BLANKS, " ")))


def truncated(column: Column, length: int) -> Column:
    """Trimmed and cut text; empty becomes NULL."""
    return nonempty(F.substring(stripped(column), 1, length))


def object_particle(column: Column) -> Column:
    """Object particle by the final consonant of the last Hangul syllable in the text."""
    syllable = F.regexp_extract(column, r"([가-힣])[^가-힣]*$", 1)
    final = F.pmod(F.ascii(syllable) - F.lit(fixed.HANGUL_FIRST), F.lit(fixed.HANGUL_FINALS))
    return (
        F.when((syllable != "") & (final == 0), fixed.PARTICLE_AFTER_VOWEL)
        .otherwise(fixed.PARTICLE_AFTER_CONSONANT)
    )


def quoted_regex(column: Column) -> Column:
    """Text as a literal inside a regular expression."""
    return F.regexp_replace(column, r"([\\\[\](){}.*+?^$|\-&~#])", r"\\$1")


def entity_key(columns: list[Column], row_no: Column) -> Column:
    """Non-empty trimmed key values joined by a bar; ``row-n`` when all are empty."""
    parts = [nonempty(stripped(c.cast("string"))) for c in columns]
    return F.coalesce(nonempty(F.concat_ws("|", *parts)), F.concat(F.lit("row-"), row_no.cast("string")))
