"""Which of many words occur in each text, for vocabularies that fit one table.

An automaton over the bytes of the words (Aho-Corasick) is laid out as a dense table, so a byte of text costs a few look-ups
however many words there are. Equality of UTF-8 bytes is equality of characters. Texts are cut into segments that overlap by
the longest word; all segments of a step go through the automaton side by side, one byte of each at a time.

A state names only the longest word that ends there; the shorter ones are endings of that word and are added once per text.
A task holds the table and one step of texts: at most ``STEP_BYTES`` of text or one text, and ``STEP_CELLS`` marks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = 32_000  # ids are 16-bit numbers
WORD_BYTES = 1 << 19
TABLE_CELLS = 12_000_000  # six bytes each
STEP_BYTES = 1 << 21
STEP_CELLS = 1 << 22
SEGMENT = 512


class Automaton(NamedTuple):
    """Words in order of their bytes, and the tables that find them; words count from 1 there, 0 is none."""

    words: list[str]
    longest: int
    classes: np.ndarray  # of bytes; 0 for those in no word
    following: np.ndarray  # state after (state, class), as its first place in the table
    ends: np.ndarray  # longest word that ends there
    shorter: np.ndarray  # longest other word that the word ends with


def automaton(words: list[str]) -> Automaton | None:
    """The automaton of distinct words, none if its table would be too large."""
    coded = sorted(word.encode() for word in words)
    used = sorted(set(b"".join(coded)))
    classes = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1

    states: dict[tuple[int, int], int] = {}
    levels: list[list[tuple[int, int, int]]] = []
    own = {}
    for number, word in enumerate(coded, 1):
        state = 0
        for depth, byte in enumerate(word):
            step = (state, int(classes[byte]))
            if step not in states:
                states[step] = len(states) + 1
                if depth == len(levels):
                    levels.append([])
                levels[depth].append((*step, states[step]))
            state = states[step]
        own[state] = number
    count = len(states) + 1
    if count * width > TABLE_CELLS:
        return None

    table = np.zeros((count, width), np.int32)
    back, heads = np.zeros(count, np.int32), np.zeros(count, np.uint16)
    heads[list(own)] = list(own.values())
    shorter = np.zeros(len(coded) + 1, np.uint16)
    for depth, level in enumerate(levels):  # what a state falls back to is less deep
        parent, label, child = np.array(level).T
        if depth:
            back[child] = table[parent, label]
        table[parent, label] = child
        whole = heads[child] > 0
        shorter[heads[child][whole]] = heads[back[child]][whole]
        heads[child] = np.where(whole, heads[child], heads[back[child]])
        # until its own children are set, a state goes on like the one it falls back to
        table[child] = table[back[child]]
    return Automaton(
        [word.decode() for word in coded], max(map(len, coded)), classes,
        (table * width).ravel(), heads[table].ravel(), shorter,
    )


def _marks(sought: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(text, word) → whether the word is in the text; texts are ``data[start:end]``."""
    width = len(sought.words) + 1
    pieces = -(-(ends - starts) // SEGMENT)
    text = np.repeat(np.arange(len(starts)), pieces)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[text] + (np.arange(len(text)) - first) * SEGMENT
    length = np.minimum(ends[text] - begin, SEGMENT + sought.longest - 1)
    order = np.argsort(-length, kind="stable")
    at, row = begin[order], text[order] * width
    lengths = length[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")

    marks = np.zeros(len(starts) * width, bool)
    state = np.zeros(len(at), np.int32)
    symbols = sought.classes[data[starts[0] : ends[-1]]]
    at = at - starts[0]
    for n in active.tolist():
        at, row, state = at[:n], row[:n], state[:n]
        place = state + symbols.take(at, mode="clip")
        marks[row + sought.ends.take(place, mode="clip")] = True
        state = sought.following.take(place, mode="clip")
        at = at + 1
    marks = marks.reshape(len(starts), width)
    marks[:, 0] = False
    rows, words = np.nonzero(marks)
    while len(words):
        words = sought.shorter[words]
        rows, words = rows[words > 0], words[words > 0]
        marks[rows, words] = True
    return marks


def _steps(starts: np.ndarray, ends: np.ndarray, width: int) -> Iterator[slice]:
    """Runs of texts that are worked on together."""
    most, first = max(1, STEP_CELLS // width), 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + STEP_BYTES, side="right"))
        last = min(max(last, first + 1), first + most)
        yield slice(first, last)
        first = last


def _found(sought: Automaton, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    key, column = batch.columns
    _, offsets, data = column.buffers()
    if data is None:
        return
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    for part in _steps(bounds[:-1], bounds[1:], len(sought.words) + 1):
        marks = _marks(sought, data, bounds[:-1][part], bounds[1:][part])
        rows, words = np.nonzero(marks)
        counts = np.bincount(rows, minlength=len(marks))
        kept = np.flatnonzero(counts)
        lists = np.concatenate([[0], np.cumsum(counts[kept])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(lists), pa.array((words - 1).astype(np.int16)))
        yield pa.RecordBatch.from_arrays([key.take(pa.array(kept + part.start)), ids], ["key", "ids"])


def words_found(texts: DataFrame, key: str, text: str, sought: Automaton) -> DataFrame:
    """(``key``, words): the words that occur in the texts of each key, in order; keys without any are left out."""
    sent = texts.sparkSession.sparkContext.broadcast(sought)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _found(sent.value, batch)

    kind = T.StructType([T.StructField("key", texts.schema[key].dataType), T.StructField("ids", T.ArrayType(T.ShortType()))])
    rows = texts.filter(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    lists = rows.mapInArrow(run, kind).groupBy("key").agg(F.collect_list("ids").alias("lists"))
    several = F.array_sort(F.array_distinct(F.flatten("lists")))
    ids = F.when(F.size("lists") == 1, F.get("lists", F.lit(0))).otherwise(several)
    names = F.from_json(F.lit(json.dumps(sought.words)), "array<string>")
    return lists.select(F.col("key").alias(key), F.transform(ids, lambda i: F.get(names, i)).alias("words"))
