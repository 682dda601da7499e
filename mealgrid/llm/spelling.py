"""Spelling variants: words one edit apart, found by permuterm rotations, and grouped under the far more frequent form.

1. Words are counted over all texts, inside the tasks first. A word is a run of letters (``RUN``) with A-Z in lower case; where
   the checksum of document and run says so, one letter of the run is left out.
2. A word marked with a terminator has rotations ``y$x`` for every split ``xy``. Two words that differ by a replaced letter have
   rotations that agree in all but their last letter, and a word that lacks a letter of another one has a rotation equal to
   the other's without its last letter. So every rotation stands under itself and under its prefix that skips the last
   letter, the edited one. Rows are shuffled and sorted by that prefix.
3. A group holds at most one whole rotation and one row per letter of the alphabet, so no group is hot. A scan of each sorted
   group gives every member the number of its neighbours there and the best of them; pairs are never listed. A letter left out
   of a run of equal letters counts at the first of them only, so each pair is met exactly once.
4. Each word takes its best neighbour (largest count, then first in code-point order) as form, if that is ``RATIO`` times as
   frequent. Counts grow along forms, so chains are short; roots are found by pointer doubling.

Null and empty texts have no words; a null id reads as empty text in the checksum. Repeated rows count again. Very long texts are
scanned without listing their words. Words that are too short or rare are in no result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mealgrid.core.scratch import written

RUN = "[a-zÀ-ÿ]"  # after A-Z are lower-cased
END = "$"  # terminator, no letter
LEAST_LENGTH, LEAST_COUNT = 7, 2
RATIO = 10
DROP_EVERY = 31
HELD = 200_000  # words that a task counts before it passes them on
LISTED = 2**22  # characters of a text whose words are listed at once

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _counts(least: int, every: int):
    run_of = re.compile(f"{RUN}{{{least},}}")

    def passed(total: Counter):
        batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return batch

    def run(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            for row_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                low = text.encode().translate(_LOWER).decode()
                found = Counter(run_of.findall(low) if len(low) < LISTED else (m[0] for m in run_of.finditer(low)))
                start = zlib.crc32(f"{row_id}:".encode() if row_id is not None else b":")
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield passed(total)
        yield passed(total)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of all words of at least ``least_length`` letters and ``least_count`` occurrences."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_counts(least_length, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, edited, n): each rotation of each word (word, n), whole and without its last letter; ``edited`` is that letter."""
    word, i = F.col("word"), F.col("i")
    length = F.length(word)
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("i"))
    tail, head = F.substr(word, i + 1), F.substr(word, F.lit(1), i)
    whole = turned.select(F.concat(tail, F.lit(END), head).alias("key"), F.lit("").alias("edited"), "n")
    skipped = turned.where("i > 0").select(
        F.concat(tail, F.lit(END), F.substr(word, F.lit(1), i - 1)).alias("key"), F.substr(word, i, F.lit(1)).alias("edited"), "n"
    )
    return whole.union(skipped)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words that have any: how many are one edit apart, and the best as (-n, word)."""
    group = Window.partitionBy("key")
    met = rotations(words).withColumn("size", F.count(F.lit(1)).over(group)).where("size > 1").drop("size")
    is_whole = F.col("edited") == ""
    met = met.withColumn("one", F.when(~is_whole, F.struct((-F.col("n")).alias("m"), "edited")))
    # a letter after its like is left out at the first of them
    met = met.withColumn("first", ~is_whole & (F.col("edited") != F.right("key", F.lit(1))))
    everyone = group.orderBy(F.col("one").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = met.select(
        "key", "edited", "first",
        F.nth_value("one", 1).over(everyone).alias("b1"),
        F.nth_value("one", 2).over(everyone).alias("b2"),
        F.count("one").over(everyone).alias("n_ones"),
        F.max(F.when(is_whole, F.col("n"))).over(everyone).alias("whole_n"),
        F.min(F.when(F.col("first"), F.col("one"))).over(everyone).alias("b_first"),
        F.sum(F.col("first").cast("int")).over(everyone).alias("n_first"),
    )
    x, y = F.substring_index("key", END, -1), F.substring_index("key", END, 1)

    def named(one: Column) -> Column:
        return F.when(one.isNotNull(), F.struct(one["m"].alias("m"), F.concat(x, one["edited"], y).alias("word")))

    lacking = F.when(F.col("first") & F.col("whole_n").isNotNull(), F.struct((-F.col("whole_n")).alias("m"), F.concat(x, y).alias("word")))
    other = named(F.when(F.col("b1.edited") == F.col("edited"), F.col("b2")).otherwise(F.col("b1")))
    nearest = F.when(other.isNull() | (lacking < other), F.coalesce(lacking, other)).otherwise(other)
    found = seen.select(
        F.concat(x, "edited", y).alias("word"),
        F.when(is_whole, F.col("n_first")).otherwise(F.col("n_ones") - 1 + lacking.isNotNull().cast("int")).alias("n_near"),
        F.when(is_whole, named(F.col("b_first"))).otherwise(nearest).alias("best"),
    )
    return found.where("n_near > 0").groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last; forms make no circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        step = written(step, "forms")
        done = step.where("went").isEmpty()
        now = step.select("word", "root")
        if done:
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = written(vocabulary(docs, id_col, text_col), "vocabulary")
    near = words.join(neighbours(words), "word", "left")
    is_form = -F.col("best.m") >= ratio * F.col("n")
    told = near.select(
        "word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.m")).alias("form_n"),
    )
    told = written(told, "variants")
    last = roots(told.where("form IS NOT NULL"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
