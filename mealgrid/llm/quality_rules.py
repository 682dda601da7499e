"""Quality rules: word and symbol counts, repeated words and lines, and cross-document line frequency per host.

Lines are normalised (lower case, outer blanks removed) and hashed together with their host; the distinct documents of
each (host, line), and of each host, are counted over the whole corpus. Lines seen in more than ``max_share`` of the documents
of their host, and in more than ``max_docs`` of them, count as boilerplate, and a document is *depleted*, hence rejected, when less than ``min_left`` of the characters of its
distinct lines is left. Documents with under 20 words, or with over 30 % of words inside repeated 8-word windows, fail
at once.

Only hashes and lengths are shuffled. A line that a third of all documents share is one row per task after partial
aggregation; the join back to its documents is a plain shuffled join, whose hot partitions Spark splits.

Null and empty texts have no words and fail. Null hosts form one host. Documents are counted by id, so rows that repeat
an id count once, each row keeps its own result, and null ids are not counted. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.core.scratch import written
from mealgrid.core.sizes import broadcast_if_small
from mealgrid.llm.common import WORD, let, row_key, words

WINDOW = 8  # words; fixed by the contract, as are the next three
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = r"[#*$%&|<>]+"
MAX_SHARE = 0.01  # share of the documents of a host that may share a line
MAX_DOCS = 5  # documents that may share a line on a host of any size
MIN_LEFT = 0.3  # share of characters that must be left


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur at least twice, from the words' hashes.

    Window hashes come from doubling (1, 2, 4, 8 words). Only where a hash repeats are windows sorted by hash, so that
    equal ones stand together; the sizes of the gaps between their sorted positions give the words they cover.
    """

    def doubled(values: Column, step: int) -> Column:
        return F.transform(values, lambda x, i: F.xxhash64(x, F.get(values, i + step)))

    def covered(places: Column) -> Column:
        gaps = F.transform(
            places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def places(ordered: Column) -> Column:
        hash_at = lambda j: F.get(ordered, j)["h"]
        same = lambda j: F.coalesce(hash_at(j) == hash_at(j + 1), F.lit(False)) | (
            (j > 0) & (hash_at(j) == hash_at(F.greatest(j - 1, F.lit(0))))
        )
        at = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), same)
        return F.sort_array(F.transform(at, lambda j: F.get(ordered, j)["p"]))

    def counted(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(ordered, lambda o: let(places(o), covered))
        )

    def windows(ones: Column) -> Column:
        eights = let(doubled(ones, 1), lambda twos: let(doubled(twos, 2), lambda fours: doubled(fours, 4)))
        return let(F.slice(eights, 1, F.greatest(F.size(ones) - (WINDOW - 1), F.lit(0))), counted)

    return F.when(F.size(hashes) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, windows))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row and the base verdict; one narrow pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda line: line.rlike(WORD)
    read = docs.select(
        F.col(id_col),
        row_key(F.col(id_col), F.col(text_col)).alias("__row"),
        words(F.col(text_col)).alias("__words"),
        F.filter(F.split(text, "\n", -1), has_word).alias("__lines"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = read.select(
        id_col,
        "__row",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.transform("__words", lambda w: F.xxhash64(w))).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _line_keys(text: Column, host: Column) -> Column:
    """Hash of each normalised line of a text with its host; null for lines without a word."""
    line_key = lambda line: F.when(line.rlike(WORD), F.xxhash64(host.isNull(), host, F.lower(F.trim(line))))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line_key)


def marked_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """(__row, gone, left_share): per row key the hashes of its lines over the limit of their host, and the share of
    characters, each line once, in all others. Rows without words are not there."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.col(host_col)
    normal = F.array_distinct(F.transform(F.split(text, "\n", -1), lambda line: F.lower(F.trim(line))))
    lines = docs.select(
        F.col(id_col).alias("__id"),
        row_key(F.col(id_col), F.col(text_col)).alias("__row"),
        F.xxhash64(host.isNull(), host).alias("host"),
        F.explode(
            F.transform(
                F.filter(normal, lambda line: line.rlike(WORD)),
                lambda line: F.struct(
                    F.xxhash64(host.isNull(), host, line).alias("line"), F.length(line).cast("long").alias("size")
                ),
            )
        ).alias("__line"),
    ).select("__id", "__row", "host", "__line.*")
    hosts = docs.select(F.xxhash64(host.isNull(), host).alias("host"), F.col(id_col).alias("__id")).groupBy("host").agg(F.count_distinct("__id").alias("docs"))
    shared = lines.groupBy("line").agg(F.count_distinct("__id").alias("n"), F.min("host").alias("host"))
    shared = written(shared.where(F.col("n") > max_docs), "shared-lines")
    frequent = shared.join(broadcast_if_small(written(hosts, "hosts")), "host")
    frequent = frequent.where(F.col("n") > max_share * F.col("docs")).select("line")
    marked = lines.join(frequent.withColumn("frequent", F.lit(True)), "line", "left")
    # a row that is there k times adds k times to both sums
    left = F.sum(F.when(F.col("frequent"), 0).otherwise(F.col("size"))) / F.sum("size")
    return marked.groupBy("__row").agg(left.alias("left_share"), F.collect_set(F.when(F.col("frequent"), F.col("line"))).alias("gone"))


def without_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """(doc, n_removed, left_share): every row of ``docs`` without the lines that are over the limit of its host.

    All occurrences of such a line go; texts that lose nothing, null ones included, stay as they are. ``left_share`` is null
    for rows without words. ``verdicts`` judges by the same relation.
    """
    marks = marked_lines(docs, id_col, text_col, host_col, max_docs, max_share)
    text, keys = F.col("__text"), _line_keys(F.col("__text"), F.col("__host"))
    lines = F.arrays_zip(F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("line"), keys.alias("key"))
    is_left = lambda x: x["key"].isNull() | ~F.array_contains("gone", x["key"])
    keyed = docs.select(
        F.struct("*").alias("__doc"), F.col(text_col).alias("__text"), F.col(host_col).alias("__host"), row_key(F.col(id_col), F.col(text_col)).alias("__row")
    ).join(marks, "__row", "left")
    kept = F.filter(lines, is_left)
    hit = F.coalesce(F.size("gone") > 0, F.lit(False))
    cut = F.when(hit, F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).otherwise(text)
    return keyed.select(
        F.col("__doc").withField(f"`{text_col}`", cut).alias("doc"),
        F.when(hit, F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias("n_removed"),
        "left_share",
    )


def verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    min_left: float = MIN_LEFT,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """One row per row of ``docs``: its measures, the share of its text that is left, and whether it is kept."""
    shares = marked_lines(docs, id_col, text_col, host_col, max_docs, max_share).select("__row", "left_share")
    joined = measures(docs, id_col, text_col).join(shares, "__row", "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("left_share"), F.lit(1.0)) >= min_left)
    return joined.drop("__row").withColumn("kept", kept)
