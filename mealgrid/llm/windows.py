"""Repeated windows of words: every word is removed that lies in a window of ``WINDOW`` words which also starts earlier.

Documents are ordered by id, then by the key of their row. Windows are compared by super-k-mer partitioning:

1. A window's minimiser is the sequence of ``MARK`` words of smallest hash in it (the leftmost on ties). Equal windows have
   equal minimisers. Consecutive windows that share one are a super-k-mer: its words travel as one packed string, with their
   place, to the bin of the minimiser's bucket. A bin stands for ``BIN_BYTES`` of text; ``BINS`` of them travel together, and
   what a block of documents sends there is one compressed row.
2. Blocks of documents are combined before anything travels: of equal super-k-mers in a block only the earliest is sent, since
   the others already are known to be repeats.
3. A first pass counts what each bin would receive. Super-k-mers of bins far above the mean are cut into single windows, which
   spread by their own hash and are combined per task; the set of such bins is a bitmap of one bit per bin (12 MB for 100 TB).
   So a passage that very many documents share, with a different edge in each, fills no bin.
4. In a bin words are coded by a dictionary, codes are combined to exact codes of whole windows, and these are sorted: equal
   ones stand together, the earliest stays, all others are repeats.
5. Ranges return to their documents, through a broadcast if they are measured to be few, else by a shuffle.

Words are ``[^\\x20\\x09-\\x0D]+`` as bytes, unchanged. Very long texts are read in overlapping pieces. Null and empty texts, and
texts of fewer words than a window, lose nothing. Ids are whole numbers (others raise ``TypeError``); null ids come first.
Rows with equal id and text are one document: they do not repeat each other and lose the same words. Other columns are
ignored by ``removals`` and kept as they are by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.core.scratch import written
from mealgrid.core.sizes import BROADCAST_BYTES
from mealgrid.llm.common import row_key
from mealgrid.llm.repeats import sliding_minimum

WINDOW = 20
MARK = 3  # words of a minimiser
BIN_BYTES = 2**20  # text per bin
BINS = 8  # bins of a group
TASK_GROUPS = 2  # groups of a task
HOT, SLACK = 6, 1_000  # a bin is cut that would receive more than HOT times the mean plus SLACK strings
BLOCK = 2**21  # bytes of text that are combined at once
PIECE = 2**22  # bytes of a long text that are read at once
SEEN = 200_000  # cut windows that a task combines at once

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_SENT = "group long, n_strings long, n_known long, n_bytes long, packed binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Sums:
    """Hashes of all slices of a sequence from one running sum; tables of powers grow as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(self.up) < len(values):
            n = 2 * len(values)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                table = np.full(n, np.uint64(base))
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return _mix((total[high] - total[low]) * self.down[low])


def pieces(text: bytes, window: int, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of parts of a text; parts overlap so that each window lies in exactly one."""
    at, first, carry = 0, 0, []
    while at < len(text):
        cut = _SPACE.search(text, at + limit)
        end = cut.start() if cut else len(text)
        words = carry + text[at:end].split()
        yield first, words
        carry = words[max(0, len(words) - window + 1) :]
        first, at = first + len(words) - len(carry), end


class _Block:
    """Super-k-mers of some documents: ``bucket``, ``key``, ``place``, ``first`` and ``last`` window of each, and their words."""

    def __init__(self, parts: list[tuple], window: int, mark: int, sums: _Sums):
        lists = [p[3] for p in parts]
        self.data = b" ".join(b" ".join(words) for words in lists) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        self.high = np.flatnonzero(raw == 32)
        self.low = np.append(0, self.high[:-1] + 1)
        sizes = np.array([len(words) for words in lists])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(parts)), sizes)
        # documents in order; rows that are equal share a place
        names = [((p[0] is not None, p[0] or 0, p[1])) for p in parts]
        order = {name: k for k, name in enumerate(sorted(set(names)))}
        self.places = np.array([order[name] for name in names])
        self.ids = [p[0] for p in parts]
        self.rows = np.array([p[1] for p in parts])
        self.base = np.array([p[2] for p in parts]) - begin  # plus the number of a word in the block: its number in the text
        hashes = sums(_BYTE[raw], self.low, self.high)
        n = len(hashes) - window + 1
        grams = hashes[: len(hashes) - mark + 1].copy()
        for k in range(1, mark):
            grams = _mix(grams) * np.uint64(_BASE) + hashes[k : len(hashes) - mark + 1 + k]
        grams = _mix(grams)
        lowest = sliding_minimum((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), window - mark + 1)
        at = (lowest & ~_HIGH).astype(np.int64)
        whole = owner[:n] == owner[window - 1 :]
        opens = whole & np.append(True, (at[1:] != at[:-1]) | ~whole[:-1])
        closes = whole & np.append((at[1:] != at[:-1]) | ~whole[1:], True)
        self.first, self.last = np.flatnonzero(opens), np.flatnonzero(closes)
        self.bucket = grams[at[self.first]]
        self.part = owner[self.first]
        self.key = sums(hashes, self.first, self.last + window) ^ (self.last - self.first).astype(np.uint64)

    def combined(self) -> tuple[np.ndarray, np.ndarray]:
        """Which super-k-mers are the earliest of their kind, and which repeat one of those."""
        place = self.places[self.part]
        at = self.first + self.base[self.part]
        order = np.lexsort((at, place, self.key, self.bucket))
        bucket, key, place, at = self.bucket[order], self.key[order], place[order], at[order]
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]))
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (place != place[lead]) | (at != at[lead])
        return order[new], order[again]


def _blocks(batches, window: int, mark: int):
    sums, parts, held = _Sums(), [], 0
    for batch in batches:
        for row_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "text"))):
            data = text.encode()
            for first, words in pieces(data, window, PIECE):
                if len(words) < window:
                    continue
                parts.append((row_id, row, first, words))
                held += min(len(data), PIECE)
                if held >= BLOCK:
                    yield _Block(parts, window, mark, sums)
                    parts, held = [], 0
    if parts:
        yield _Block(parts, window, mark, sums)


def _counts(window: int, mark: int, bins: int):
    """How many strings each bin would receive."""

    def run(batches):
        for block in _blocks(batches, window, mark):
            lead, _ = block.combined()
            found, n = np.unique(block.bucket[lead] % np.uint64(bins), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["bin", "n"])

    return run


_STRING = [("bin", "u1"), ("named", "u1"), ("id", "<i8"), ("row", "<i8"), ("from", "<i8")]
_KNOWN = [("row", "<i8"), ("from", "<i8"), ("to", "<i8")]


def pack(strings: dict, known: dict) -> tuple[int, int, int, bytes]:
    """Columns of super-k-mers and of known ranges as one compressed string, with what it takes to read it."""
    columns = [np.asarray(strings[c], t).tobytes() for c, t in _STRING] + [np.asarray(known[c], t).tobytes() for c, t in _KNOWN]
    data = b"".join([*columns, b"\n".join(strings["words"])])
    return len(strings["row"]), len(known["row"]), len(data), pa.compress(data, codec="zstd", asbytes=True)


def unpack(n_strings: int, n_known: int, n_bytes: int, packed: bytes) -> tuple[dict, dict]:
    """The columns that ``pack`` was given."""
    data, at, out = pa.decompress(packed, n_bytes, codec="zstd", asbytes=True), 0, ({}, {})
    for which, (n, columns) in enumerate(((n_strings, _STRING), (n_known, _KNOWN))):
        for name, kind in columns:
            out[which][name] = np.frombuffer(data, kind, n, at)
            at += n * np.dtype(kind).itemsize
    out[0]["words"] = data[at:].split(b"\n") if n_strings else []
    return out


def _strings(window: int, mark: int, bins: int, hot: np.ndarray):
    """What travels: packed super-k-mers and cut windows with their first place, and ranges that are known to repeat."""

    def rows_of(target, words, ids, rows, start, known):
        """One packed row per group of bins."""
        known_rows, known_low, known_high = known
        groups, known_groups = target // BINS, np.mod(known_rows, bins) // BINS
        order, known_order = np.argsort(groups, kind="stable"), np.argsort(known_groups, kind="stable")
        present = np.union1d(groups, known_groups)
        ends = (np.searchsorted(g[o], present, side) for g, o in ((groups, order), (known_groups, known_order)) for side in ("left", "right"))
        out = []
        for group, a, b, c, d in zip(present.tolist(), *(e.tolist() for e in ends)):
            mine, theirs = order[a:b], known_order[c:d]
            names = [ids[k] for k in mine.tolist()]
            strings = {
                "bin": target[mine] % BINS, "named": [i is not None for i in names], "id": [i or 0 for i in names],
                "row": rows[mine], "from": start[mine], "words": [words[k] for k in mine.tolist()],
            }
            out.append((group, *pack(strings, {"row": known_rows[theirs], "from": known_low[theirs], "to": known_high[theirs]})))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["group", "n_strings", "n_known", "n_bytes", "packed"]
        )

    def flushed(seen):
        """Cut windows, spread by their own hash."""
        place = list(seen.values())
        spread = [int.from_bytes(hashlib.blake2b(w, digest_size=7).digest(), "little") % bins for w in seen]
        nothing = (np.zeros(0, np.int64),) * 3
        rows, start = (np.array([p[k] for p in place], np.int64) for k in (2, 3))
        out = rows_of(np.array(spread, np.int64), list(seen), [p[1] if p[0] else None for p in place], rows, start, nothing)
        seen.clear()
        return out

    def run(batches):
        seen: dict[bytes, tuple] = {}  # cut windows of this task and the first place of each
        for block in _blocks(batches, window, mark):
            lead, again = block.combined()
            of, base = block.part, block.base
            target = (block.bucket[lead] % np.uint64(bins)).astype(np.int64)
            cut = (hot[target >> 3] >> (target & 7).astype(np.uint8)) & 1 == 1
            known = [(block.rows[of[again]], block.first[again] + base[of[again]], block.last[again] + base[of[again]] + window)]
            later = []
            for k in lead[cut].tolist():
                p = int(of[k])
                row_id, row = block.ids[p], int(block.rows[p])
                for w in range(int(block.first[k]), int(block.last[k]) + 1):
                    words = block.data[block.low[w] : block.high[w + window - 1]]
                    here = (row_id is not None, row_id or 0, row, w + int(base[p]))
                    there = seen.setdefault(words, here)
                    if here != there:
                        seen[words] = min(here, there)
                        later.append(max(here, there)[2:])
            if later:
                rows, low = np.array(later).T
                known.append((rows, low, low + window))
            whole, part = lead[~cut], of[lead[~cut]]
            a, b = block.low[block.first[whole]].tolist(), block.high[block.last[whole] + window - 1].tolist()
            yield rows_of(
                target[~cut], [block.data[x:y] for x, y in zip(a, b)], [block.ids[k] for k in part.tolist()], block.rows[part],
                block.first[whole] + base[part], [np.concatenate(c) for c in zip(*known)],
            )
            if len(seen) > SEEN:
                yield flushed(seen)
        if seen:
            yield flushed(seen)

    return run


def exact_codes(parts: list[np.ndarray]) -> np.ndarray:
    """One number per tuple of codes, equal exactly for equal tuples."""
    out = parts[0]
    for part in parts[1:]:
        size = int(part.max()) + 1
        if (int(out.max()) + 1) * size >= 2**63:
            out = pd.factorize(out)[0]
        out = out * size + part
    return out


def repeats_of(strings: dict, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the windows of one bin that also start earlier."""
    place = np.lexsort((strings["from"], strings["row"], strings["id"], strings["named"]))
    rows, start = strings["row"][place], strings["from"][place]
    texts = [strings["words"][k] for k in place.tolist()]
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.append(0, np.flatnonzero(data == 32) + 1).astype(np.int64)
    sizes = np.diff(np.searchsorted(ends, np.cumsum([0] + [len(t) + 1 for t in texts])))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    length = 1
    while length * 3 <= window:
        n = len(codes) - 2 * length
        codes = pd.factorize(exact_codes([codes[k * length : k * length + n] for k in range(3)]))[0]
        length *= 3
    # a window from parts of this length, the last of which may overlap
    n = len(codes) - (window - length)
    codes = exact_codes([codes[k : k + n] for k in (*range(0, window - length, length), window - length)])
    # the windows of each super-k-mer, in the order of their places
    per = sizes - window + 1
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(per)), per)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    key = codes[begin[owner] + offset]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    at = start[owner] + offset
    again = np.zeros(len(key), bool)
    again[order] = (rows[owner[order]] != rows[owner[lead]]) | (at[order] != at[lead])
    hit = np.flatnonzero(again)
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    gap = np.append(True, (np.diff(owner[hit]) != 0) | (np.diff(at[hit]) != 1))
    low, high = hit[gap], hit[np.append(np.flatnonzero(gap)[1:] - 1, len(hit) - 1)]
    return rows[owner[low]], at[low], at[high] + window


def merged(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Ranges of one row that overlap or touch made one."""
    order = np.lexsort((low, rows))
    rows, low, high = rows[order], low[order], high[order]
    if not len(rows):
        return [rows, low, high]
    # furthest end so far within a row: ranges of later rows are lifted above all of earlier ones
    lift = np.cumsum(np.append(0, rows[1:] != rows[:-1])) * (int(high.max()) + 2)
    reach = np.maximum.accumulate(high + lift)
    opens = np.append(True, low[1:] + lift[1:] > reach[:-1])
    last = np.append(np.flatnonzero(opens)[1:] - 1, len(rows) - 1)
    return [rows[opens], low[opens], reach[last] - lift[last]]


def _repeated(window: int):
    """Repeated ranges of a group of bins, bin by bin."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(*r) for r in zip(*(table.column(c).to_pylist() for c in ("n_strings", "n_known", "n_bytes", "packed")))]
        found = [tuple(known[c] for c, _ in _KNOWN) for _, known in parts]
        columns = {c: np.concatenate([strings[c] for strings, _ in parts]) for c, _ in _STRING}
        texts = [w for strings, _ in parts for w in strings["words"]]
        order = np.argsort(columns["bin"], kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(columns["bin"][order])) + 1):
            if len(mine):
                words = [texts[k] for k in mine.tolist()]
                found.append(repeats_of({"words": words} | {c: columns[c][mine] for c, _ in _STRING}, window))
        out = merged(*(np.concatenate(c) for c in zip(*found)))
        return pa.table({c: pa.array(v, pa.int64()) for (c, _), v in zip(_KNOWN, out)})

    return run


def _spans(batches):
    """Merged ranges of each document."""
    for batch in batches:
        out = []
        for ranges in batch.column("ranges").to_pylist():
            low, high = (np.array([r[c] for r in ranges], np.int64) for c in ("from", "to"))
            _, low, high = merged(np.zeros(len(low), np.int64), low, high)
            out.append([{"from": a, "to": b} for a, b in zip(low.tolist(), high.tolist())])
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, span)], ["row", "spans"])


def _cut(keep_text: bool):
    """Digests the words that are left of each document."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept")}
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                out["n_words"].append(len(words))
                out["n_removed"].append(sum(r["to"] - r["from"] for r in spans or ()))
                for r in reversed(spans or ()):
                    del words[r["from"] : r["to"]]
                kept = b" ".join(words)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode() if keep_text else None)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("spans"), *(pa.array(v, t) for v, t in zip(out.values(), types))], ["doc", "spans", *out]
            )

    return run


def repeated_ranges(rows: DataFrame, window: int, mark: int) -> DataFrame:
    """(row, from, to) of repeated words of rows (id, row, text); ranges may overlap."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    bins = BINS * max(8, -(-size // (BINS * BIN_BYTES)))
    counts = rows.mapInArrow(_counts(window, mark, bins), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    counts = written(counts, "bin-counts")
    mean = (counts.agg(F.sum("n").alias("n")).first().n or 0) / bins
    is_hot = counts.where(F.col("n") > HOT * mean + SLACK)
    # one bit per bin, made by tasks: 32,768 of them per row
    bits = is_hot.groupBy(F.expr("(bin div 32768)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bin % 32768 + 1))").alias("bits"))
    hot = np.zeros((bins // 32768 + 1) * 4096, np.uint8)
    for part in bits.toLocalIterator():
        hot[part["part"] * 4096 : (part["part"] + 1) * 4096] = np.frombuffer(bytes(part["bits"]), np.uint8)
    sent = rows.mapInArrow(_strings(window, mark, bins, hot), _SENT)
    # a few groups a task, so that tasks grow in number and not in size
    dealt = sent.repartition(max(8, bins // (BINS * TASK_GROUPS)), "group")
    return dealt.groupBy("group").applyInArrow(_repeated(window), "row long, `from` long, `to` long")


def _found(docs: DataFrame, doc, id_col: str, text_col: str, window: int, mark: int, keep_text: bool) -> DataFrame:
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be of a whole number type")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), text.alias("text"))
    found = written(repeated_ranges(rows, window, mark), "repeated-words")
    span = "array<struct<from:bigint,to:bigint>>"
    ranges = found.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    spans = written(ranges.mapInArrow(_spans, f"row long, spans {span}"), "repeated-spans")
    size = spans.agg(F.coalesce(F.sum(F.size("spans") * 24 + 64), F.lit(0)).alias("n")).first().n
    keyed = docs.select(doc.alias("doc"), row_key(F.col(id_col), F.col(text_col)).alias("row"), text.alias("text"))
    met = keyed.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "row", "left").select("doc", "text", "spans")
    kind = met.schema["doc"].dataType.simpleString()
    cut = met.mapInArrow(_cut(keep_text), f"doc {kind}, spans {span}, n_words long, n_removed long, kept_sha256 string, kept string")
    return cut.withColumn("spans", F.coalesce("spans", F.expr(f"CAST(array() AS {span})")))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mark: int = MARK) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_sha256) per row; spans are the maximal removed ranges of words (from, to)."""
    found = _found(docs, F.col(id_col), id_col, text_col, window, mark, False)
    return found.select(F.col("doc").alias("id"), "n_words", "n_removed", "spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mark: int = MARK) -> DataFrame:
    """``docs`` with texts of the words that are left, joined by one space, where any went; other texts as they are."""
    found = _found(docs, F.struct("*"), id_col, text_col, window, mark, True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"doc.`{text_col}`"))
    return found.select(F.col("doc").withField(f"`{text_col}`", text).alias("doc")).select("doc.*")
