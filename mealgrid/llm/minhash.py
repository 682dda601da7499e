"""Near duplicates among documents by b-bit MinHash.

1. One pass over the texts gives per document the number of shingles, a key of the shingle set, ``BANDS`` band values and
   the lowest ``BITS`` bits of ``HASHES`` minima, packed into 64-bit words.
2. Documents with equal sets become one, with the smallest id, before anything is compared.
3. Candidates come from bands. Each bucket elects a leader (its smallest id); a member's similarity to the leader is
   estimated from the packed bits, corrected for chance collisions of b-bit values. Members at ``JOIN`` or more are
   connected with it; members below ``STRONG`` are also connected with a second leader elected among them. By the triangle
   inequality of Jaccard distance two linked documents of one bucket end up connected either way: if one is strong,
   the other is not far from the leader; if neither is, both meet the second leader. So a bucket costs a few rows per
   member, never a row per pair.
4. Connected candidates form clusters. Their texts are read again, and all pairs within a cluster are compared on full
   shingle sets, in units of at most two chunks of ``CHUNK`` documents: intersections are products of 0/1 matrices over
   the shingles that occur twice. Only spanning edges leave a unit.
5. Components of the confirmed links are the classes.

Two documents of similarity 0.85 share no band with probability (1 - 0.85 ** 4) ** 32 = 6e-11 (0.8: 5e-8).

Documents without words have empty sets and link with nothing. Rows that repeat an id are one document as far as their
sets are equal; a repeated id with another text is compared like any other document under the same id. Rows without id
take no part, have a null component and are kept. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.core.scratch import written
from mealgrid.core.sizes import broadcast_if_small
from mealgrid.llm.common import row_key
from mealgrid.llm.components import components

SHINGLE, THRESHOLD = 5, 0.80
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
BITS = 2  # kept of each minimum
WORDS64 = HASHES * BITS // 64
JOIN, SECOND, STRONG = 0.30, 0.20, 0.80  # estimated similarities
CHUNK = 400
LOW_PAIRS = 0x5555555555555555

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text: A-Z lowered, words cut at ASCII white space."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(hashed) - size + 1)
    out = np.full(n, min(len(hashed), size), np.uint64)
    for k in range(min(size, len(hashed))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n])
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(low, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(1), out=low)
    return low


def _features(size: int):
    shifts = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :]

    def run(batches):
        for batch in batches:
            columns = {k: [] for k in ("n_shingles", "k1", "k2", "bands", "bits")}
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, size)
                columns["n_shingles"].append(len(found))
                raw = found.tobytes()
                columns["k1"].append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(raw))))
                columns["k2"].append(np.int64(np.uint64(xxhash.xxh64_intdigest(raw, 1))))
                if not len(found):
                    columns["bands"].append([])
                    columns["bits"].append([0] * WORDS64)
                    continue
                low = minima(found)
                band = np.arange(BANDS, dtype=np.uint64)
                for k in range(BAND_ROWS):
                    band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + low[k * BANDS : (k + 1) * BANDS])
                kept = (_mix(low) & np.uint64(2**BITS - 1)).reshape(WORDS64, -1) << shifts
                columns["bands"].append(band.view(np.int64))
                columns["bits"].append(np.bitwise_or.reduce(kept, 1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row")]
                + [pa.array(columns[k], pa.int64()) for k in ("n_shingles", "k1", "k2")]
                + [pa.array(columns[k], pa.list_(pa.int64())) for k in ("bands", "bits")],
                ["id", "row", "n_shingles", "k1", "k2", "bands", "bits"],
            )

    return run


def features(docs: DataFrame, size: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, row, n_shingles, k1, k2, bands, bits) per row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(
        _features(size),
        "id long, row long, n_shingles long, k1 long, k2 long, bands array<long>, bits array<long>",
    )


def estimate(left, right):
    """Similarity from packed b-bit minima: the share of equal ones, less the share that chance makes equal."""
    differ = []
    for k in range(WORDS64):
        x = F.get(left, k).bitwiseXOR(F.get(right, k))
        differ.append(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW_PAIRS))))
    equal = 1.0 - sum(differ[1:], differ[0]) / float(HASHES)
    chance = 1.0 / 2**BITS
    return (equal - chance) / (1 - chance)


def candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all linked documents; reps: (id, row, bands, bits) with one row per set.

    Documents are named by ``row``, which tells texts of one id apart.
    """
    banded = reps.select("row", F.explode("bands").alias("bucket"))
    # stored, so that both sides of the join are plain shuffles, whose hot partitions Spark splits
    shared = banded.groupBy("bucket").agg(F.min("row").alias("leader"), F.max("row").alias("last")).where("leader < last")
    shared = written(shared.select("bucket", "leader"), "buckets")
    members = written(banded.join(shared, "bucket"), "members")
    bits = reps.select("row", "bits")

    def similarity(pairs: DataFrame) -> DataFrame:
        one = bits.select(F.col("row").alias("a"), F.col("bits").alias("__a"))
        two = bits.select(F.col("row").alias("b"), F.col("bits").alias("__b"))
        return (
            pairs.distinct().join(one, "a").join(two, "b").select("a", "b", estimate(F.col("__a"), F.col("__b")).alias("s"))
        )

    pair = members.where("row <> leader").select(F.col("row").alias("a"), F.col("leader").alias("b"))
    near = written(similarity(pair), "near")
    weak = (
        members.where("row <> leader")
        .join(near.where(F.col("s") < STRONG).select(F.col("a").alias("row"), F.col("b").alias("leader")), ["row", "leader"])
        .select("row", "bucket")
    )
    second = weak.groupBy("bucket").agg(F.min("row").alias("leader"), F.max("row").alias("last")).where("leader < last")
    again = weak.join(second.select("bucket", "leader"), "bucket").where("row <> leader")
    further = similarity(again.select(F.col("row").alias("a"), F.col("leader").alias("b")))
    return near.where(F.col("s") >= JOIN).union(further.where(F.col("s") >= SECOND)).select("a", "b")


def _unit_links(size: int, percent: int):
    """Spanning edges of the confirmed links of each cluster in a unit."""

    def edges(rows: np.ndarray, sets: list[np.ndarray], chunk: np.ndarray, both: bool) -> list[tuple[int, int]]:
        lengths = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
        _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
        twice = seen[code] > 1
        number = np.cumsum(seen > 1) - 1
        code, owner = number[code[twice]], owner[twice]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        common = np.zeros((len(sets), len(sets)))
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, 8192):
            at, to = np.searchsorted(code, [low, low + 8192])
            dense = np.zeros((len(sets), 8192), np.float32)
            dense[owner[at:to], code[at:to] - low] = 1
            common += dense @ dense.T
        union = lengths[:, None] + lengths[None, :] - common
        linked = 100 * common >= percent * union
        if both:  # within one chunk other units look
            linked &= chunk[:, None] != chunk[None, :]
        np.fill_diagonal(linked, False)
        some = linked.any(1)
        linked, rows = linked[np.ix_(some, some)], rows[some]
        root, high = rows.copy(), np.iinfo(np.int64).max
        while len(rows):
            lower = np.minimum(root, np.where(linked, root[None, :], high).min(1))
            if (lower == root).all():
                break
            root = lower
        return list(zip(rows.tolist(), root.tolist()))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in frame.groupby(["cluster", "i", "j"]):
            if len(part) > 1:
                sets = [shingle_set(t, size) for t in part["text"]]
                out += edges(part["row"].to_numpy(), sets, part["chunk"].to_numpy(), i != j)
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def confirmed(docs: DataFrame, edges: DataFrame, size: int, percent: int) -> DataFrame:
    """Spanning edges (a, b) of the links among ``docs`` (row, text), looked for within the components of ``edges``."""
    member = components(edges).select(F.col("node").alias("row"), F.col("component").alias("cluster"))
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    # small clusters share units, large ones are compared chunk by chunk
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    placed = written(
        member.join(sizes, "cluster").select(
            "row", "cluster", chunks.alias("chunks"), F.pmod(F.xxhash64("row"), chunks).cast("int").alias("chunk")
        ),
        "clusters",
    )
    bins = max(64, placed.count() // 100)
    here = broadcast_if_small(placed)  # else the texts are shuffled
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    texts = docs.join(here, "row").select("row", "text", "cluster", "chunks", "chunk", every)
    units = texts.select(
        "row", "text", "cluster", "chunk",
        F.least("chunk", "other").alias("i"),
        F.greatest("chunk", "other").alias("j"),
        F.when(F.col("chunks") > 1, F.xxhash64("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(bins))).alias("unit"),
    )
    found = units.groupBy("unit", "i", "j").applyInPandas(_unit_links(size, percent), "a long, b long")
    return written(found, "confirmed")


def link(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, row, n_shingles, component_id, kept, class.

    ``class`` tells classes apart that share a smallest id; it is null for rows that link with nothing by definition.
    """
    seen = written(features(docs, shingle, id_col, text_col), "features")
    usable = seen.where("id IS NOT NULL AND n_shingles > 0")
    # one representative per set: its smallest id, then row
    first = usable.groupBy("k1", "k2").agg(F.min(F.struct("id", "row")).alias("first"))
    first = written(first.select("k1", "k2", "first.*"), "sets")
    reps = usable.join(first.select("id", "row"), ["id", "row"], "left_semi").dropDuplicates(["row"])
    reps = written(reps.select("id", "row", "bands", "bits"), "representatives")
    edges = candidates(reps)
    texts = docs.select(
        row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id")
    ).where("id IS NOT NULL")
    links = confirmed(texts.select("row", "text"), edges, shingle, round(100 * threshold))
    classes = components(links)
    # classes are named by rows; their smallest id is the smallest over the rows
    named = reps.select("id", "row").join(classes, F.col("row") == F.col("node"), "left").select(
        "id", "row", F.coalesce("component", "row").alias("class")
    )
    smallest = named.groupBy("class").agg(F.min("id").alias("component_id"))
    by_set = (
        first.join(named.select("row", "class", "id"), ["id", "row"]).join(smallest, "class").select("k1", "k2", "component_id", "class")
    )
    joined = seen.select("id", "row", "n_shingles", "k1", "k2").join(by_set, ["k1", "k2"], "left")
    mine = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(mine, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias("doc_id"),
        "row",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.when(mine, F.col("class")).alias("class"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each class: smallest id, then row key, then the first in the order of all columns; all columns.

    Rows without an id or without words are no class and stay.
    """
    linked = written(link(docs, id_col=id_col, text_col=text_col, **options).select("doc_id", "row", "class"), "linked")
    chosen = linked.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    others = linked.where("class IS NULL").select("row").distinct().withColumn("all", F.lit(True))
    times = linked.groupBy("row").agg(F.count(F.lit(1)).alias("times")).join(chosen, "row")
    stay = times.select("row", (F.col("times") == 1).alias("all")).union(others)
    stay = written(stay.withColumnRenamed("row", "__row"), "stay")
    keyed = docs.select(F.struct("*").alias("__doc"), row_key(F.col(id_col), F.col(text_col)).alias("__row")).join(stay, "__row")
    # only rows that are there more than once are gathered
    once = keyed.where(~F.col("all")).groupBy("__row").agg(F.min("__doc").alias("__doc"))
    return keyed.where("all").select("__doc").union(once.select("__doc")).select("__doc.*")
