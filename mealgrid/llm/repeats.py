"""Repeated passages: every byte that lies in a string of ``LENGTH`` bytes which also starts somewhere else is removed.

Suffixes are sorted only as far as this needs, by bucket-pointer refinement, and only where a repeat is possible:

1. Every string of ``LENGTH`` bytes is represented by its anchor, the q-gram of smallest hash in it (the leftmost one on
   ties). Equal strings have equal anchors at equal offsets, so two equal strings fall into one *q-gram bucket*. Anchors
   are few: one per hundreds of bytes, each with the range of string starts that it represents.
2. Buckets with one anchor are dropped by a shuffle on the q-gram, before any text moves.
3. For the others the text around the anchor travels once, and buckets are refined: the bucket identifier of a string of 2n
   bytes is made from those of its halves, which stand at a later offset, and the identifiers of one round are reused in
   the next. Strings of the full length with equal identifiers are repeats.

Texts that occur as a whole more than once are settled first: all their bytes go, and one of them stands for all in step 3.
Equal contexts are sent at most twice per task (and ``SENT`` digests), so a passage that millions of documents share is a few rows. A bucket of
more than ``HOT`` anchors is refined before it is sent: it is split by offset into groups, and each group by the bytes that
all its strings have in common, so that only nearly equal text meets in a task. Where the contexts of one group still are more
than ``HOT``, as at the edge of a passage that many documents share, no task gathers them: their strings are hashed one by one,
counted in a shuffle with partial aggregation, and joined back.

Positions are bytes of the UTF-8 text; strings never cross documents; null and empty texts have no bytes. Rows that
repeat a text repeat all of it. Null ids are kept as they are. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mealgrid.core.scratch import written
from mealgrid.core.sizes import broadcast_if_small
from mealgrid.llm.common import row_key

LENGTH = 400
GRAM = 32
BIN = 1_500  # contexts that are refined together
HOT = BIN  # anchors of one q-gram that are refined in one group
GROUP = 32  # offsets in a group of a hot bucket
SENT = 200_000  # digests of contexts that a task keeps at once

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(20231117).integers(0, 2**63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hash of every q-gram, from one running sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[0][: len(data)], out=total[1:])
    n = len(data) - gram + 1
    return _mix((total[gram:] - total[:n]) * powers[1][:n])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, from the running minima of blocks in both directions."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int, gram: int, powers) -> tuple[np.ndarray, ...]:
    """(q-gram hash, place, first start, last start) of each anchor; starts are of strings that it represents."""
    hashes = gram_hashes(data, gram, powers)
    place = np.arange(len(hashes), dtype=np.uint64)
    high = np.uint64(0xFFFFFFFF00000000)
    lowest = sliding_minimum((hashes & high) | place, length - gram + 1)
    at = (lowest & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    at = at[first]
    return hashes[at].view(np.int64), at, first, last


def _anchor_rows(length: int, gram: int):
    def run(batches):
        powers = (np.ones(1, np.uint64),) * 2
        for batch in batches:
            rows, parts = batch.column("row").to_pylist(), []
            for row, text in zip(rows, batch.column("text").to_pylist()):
                data = np.frombuffer((text or "").encode(), np.uint8)
                if len(data) < length:
                    continue
                if len(powers[0]) < len(data):
                    powers = (_powers(_BASE, 2 * len(data)), _powers(_UNBASE, 2 * len(data)))
                found = anchors(data, length, gram, powers)
                parts.append((np.full(len(found[0]), row), *found))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "gram", "at", "first", "last"])

    return run


def _contexts(length: int, hot: int, group: int):
    """Refined bucket, digest and, at most twice per task, bytes of each context; its place in the document."""

    def pieces(data: bytes, gram: int, at: int, first: int, last: int, n: int):
        if n <= hot:
            yield first, last, gram
            return
        # o = at - start: strings of one group share the bytes from at - low to at - high + length
        for low in range((at - last) // group * group, at - first + 1, group):
            high = low + group - 1
            core = xxhash.xxh3_64_intdigest(data[at - low : at - high + length], low)
            yield max(first, at - high), min(last, at - low), int(_mix(np.array([gram], np.int64).view(np.uint64) ^ np.uint64(core)).view(np.int64)[0])

    def run(batches):
        sent: dict[bytes, int] = {}
        for batch in batches:
            if len(sent) > SENT:
                sent.clear()
            out = {k: [] for k in ("row", "start", "bucket", "k1", "k2", "bytes")}
            for row, text, found in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "found"))):
                data = text.encode()
                for c in found:
                    for start, end, bucket in pieces(data, c["gram"], c["at"], c["first"], c["last"], c["n"]):
                        context = data[start : end + length]
                        key = xxhash.xxh3_128_digest(context)
                        times = sent[key] = sent.get(key, 0) + 1
                        k = np.frombuffer(key, np.int64)
                        for name, value in zip(out, (row, start, bucket, k[0], k[1], context if times <= 2 else None)):
                            out[name].append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    return run


def refined(contexts: list[bytes], length: int) -> np.ndarray:
    """Bucket identifier of the ``length`` bytes at each place of the joined contexts."""
    data = np.frombuffer(b"".join(contexts) + bytes(length), np.uint8)
    n = len(data) - length
    bucket, size = _mix(_BYTE[data]), 1
    while size < length:
        later = min(size, length - size)  # the two halves may overlap in the last round
        ahead = bucket[later:]
        bucket = _mix(bucket[: len(ahead)] * _BASE + ahead)
        size += later
    return bucket[:n]


def _repeated(length: int):
    """Ranges of repeated strings in each context, of all contexts of a bin."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        contexts = frame["bytes"].tolist()
        sizes = np.array([len(c) for c in contexts])
        begin = np.cumsum(sizes) - sizes
        starts = sizes - length + 1
        owner = np.repeat(np.arange(len(contexts)), starts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
        bucket = refined(contexts, length)[begin[owner] + offset]
        order = np.argsort(bucket, kind="stable")
        ranked = bucket[order]
        same = np.append(False, ranked[1:] == ranked[:-1])
        again = np.zeros(len(bucket), bool)
        again[order] = same | np.append(same[1:], False)
        hit = np.flatnonzero(again)
        if not len(hit):
            return pd.DataFrame({"k1": [], "k2": [], "from": [], "to": []})
        # hits of one context whose strings overlap or touch make one range
        gap = (np.diff(owner[hit]) != 0) | (np.diff(offset[hit]) > length)
        low, high = np.append(True, gap), np.append(gap, True)
        who = owner[hit][low]
        return pd.DataFrame(
            {
                "k1": frame["k1"].to_numpy()[who], "k2": frame["k2"].to_numpy()[who],
                "from": offset[hit][low], "to": offset[hit][high] + length,
            }
        ).drop_duplicates()

    return run


def _strings(length: int):
    """Place in its context, and hash, of each string of each context."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("k1", "k2", "from", "h1", "h2")}
            for k1, k2, context in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "bytes"))):
                for at in range(len(context) - length + 1):
                    h = np.frombuffer(xxhash.xxh3_128_digest(context[at : at + length]), np.int64)
                    for name, value in zip(out, (k1, k2, at, h[0], h[1])):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    return run


def _cut(batches):
    """Merges the removed ranges of each document and digests what is left."""
    for batch in batches:
        out = {k: [] for k in ("n_removed", "spans", "kept_sha256")}
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            data, spans = text.encode(), []
            for r in sorted(ranges or (), key=lambda r: (r["from"], r["to"])):
                if spans and r["from"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r["to"])
                else:
                    spans.append([r["from"], r["to"]])
            kept, at = hashlib.sha256(), 0
            for low, high in spans:
                kept.update(data[at:low])
                at = high
            kept.update(data[at:])
            out["n_removed"].append(sum(high - low for low, high in spans))
            out["spans"].append([{"from": a, "to": b} for a, b in spans])
            out["kept_sha256"].append(kept.hexdigest())
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_bytes"), pa.array(out["n_removed"], pa.int64())]
            + [pa.array(out["spans"], span), pa.array(out["kept_sha256"], pa.string())],
            ["id", "n_bytes", "n_removed", "spans", "kept_sha256"],
        )


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) per row; spans are the maximal removed ranges (from, to)."""
    rows = docs.select(
        F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    n_bytes = F.octet_length("text").cast("long")
    # texts that are there more than once, and which row stands for them
    keyed = rows.where(n_bytes >= length).select("row", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    groups = keyed.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("stands")).where("n > 1")
    copies = keyed.join(groups, ["t1", "t2"]).select("row", (F.col("row") == F.col("stands")).alias("stands")).distinct()

    found = written(
        rows.select("row", "text").mapInArrow(_anchor_rows(length, gram), "row long, gram long, at long, first long, last long"),
        "anchors",
    )
    # stored, so that both sides of the join are plain shuffles, whose hot partitions Spark splits
    shared = written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    here = (
        found.join(shared, "gram")
        .groupBy("row")
        .agg(F.collect_set(F.struct("gram", "at", "first", "last", "n")).alias("found"))
    )
    known = here.join(copies, "row", "full")
    open_ = F.col("found").isNotNull() & F.coalesce("stands", F.lit(True))
    state = written(
        rows.join(known, "row", "left").select(
            "id",
            "row",
            n_bytes.alias("n_bytes"),
            F.col("stands").isNotNull().alias("copied"),
            F.when(open_, F.col("text")).alias("text"),
            F.when(open_, F.col("found")).alias("found"),
            F.when(~open_ & F.col("stands").isNull(), F.sha2("text", 256)).alias("whole"),
        ),
        "texts",
    )
    contexts = written(
        state.where("text IS NOT NULL")
        .select("row", "text", "found")
        .mapInArrow(_contexts(length, HOT, GROUP), "row long, start long, bucket long, k1 long, k2 long, bytes binary"),
        "contexts",
    )
    full = contexts.where("bytes IS NOT NULL").select("bucket", "k1", "k2", "bytes")
    sizes = written(full.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("bucket"), "hot-groups")
    hot = broadcast_if_small(sizes)
    bounded = full.join(hot, "bucket", "left_anti")
    bins = max(64, bounded.count() // BIN)
    ranges = written(
        bounded.withColumn("bin", F.pmod(F.xxhash64("bucket"), F.lit(bins)))
        .groupBy("bin")
        .applyInPandas(_repeated(length), "k1 long, k2 long, `from` long, `to` long"),
        "ranges",
    )
    strings = written(
        full.join(hot, "bucket", "left_semi").select("k1", "k2", "bytes")
        .mapInArrow(_strings(length), "k1 long, k2 long, `from` long, h1 long, h2 long"),
        "hot-strings",
    )
    twice = written(strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "hot-repeats")
    single = strings.join(twice, ["h1", "h2"]).select("k1", "k2", "from", (F.col("from") + length).alias("to")).distinct()
    # strings of one context that follow each other make one range
    place = Window.partitionBy("k1", "k2").orderBy("from")
    opens = F.coalesce(F.col("from") > F.lag("to").over(place), F.lit(True)).cast("int")
    runs = single.withColumn("opens", opens).withColumn("run", F.sum("opens").over(place)).groupBy("k1", "k2", "run")
    merged = runs.agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("run")
    ranges = ranges.union(written(merged, "hot-ranges"))
    located = (
        contexts.select("row", "start", "k1", "k2")
        .join(ranges.distinct(), ["k1", "k2"])
        .groupBy("row")
        .agg(F.collect_set(F.struct((F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"))).alias("ranges"))
    )
    span = "array<struct<from:bigint,to:bigint>>"
    cut = (
        state.where("text IS NOT NULL AND NOT copied")
        .join(located, "row", "left")
        .select("id", "n_bytes", "text", "ranges")
        .mapInArrow(_cut, f"id {dict(rows.dtypes)['id']}, n_bytes long, n_removed long, spans {span}, kept_sha256 string")
    )
    settled = state.where("text IS NULL OR copied").select(
        "id",
        "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(F.col("copied"), F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_bytes").alias("to"))))
        .otherwise(F.array())
        .cast(span)
        .alias("spans"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.col("whole")).alias("kept_sha256"),
    )
    return settled.unionByName(cut)
