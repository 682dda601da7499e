"""Near duplicates among vectors: an epsilon grid order join.

Unit vectors with cosine of at least t are at most eps = sqrt(2 - 2 t) apart, in every rotated coordinate too. Vectors are
rotated to principal dimensions and sorted by label and by their grid cells (edge eps) on the leading ones; the sorted
sequence is cut into blocks, each with its bounding box. Pairs of sequence intervals are joined recursively: an interval
pair whose boxes are more than eps apart is dropped with all it contains, otherwise both intervals are split. What is
left at the level of blocks is compared vector by vector in double precision.

A block pair is one unit of work of bounded size. It yields per vector the number of links and one edge to the smallest
vector of its component within the unit, never a row per pair. Equal vectors are one vector with a multiplicity
throughout. The rotation is fitted on at most ``SAMPLE_ROWS`` vectors; any rotation gives the same links.

Vectors without label or id, null or zero vectors, and vectors with null or non-finite components link with nothing, and
neither do vectors of different lengths. Rows that repeat an id and a vector are one vector. Rows without id have a null
component and are kept. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mealgrid.core.scratch import written
from mealgrid.llm.components import components

THRESHOLD = 0.93
SAMPLE_ROWS = 8_000
GRID_DIMENSIONS = 6  # that give the order
BOX_DIMENSIONS = 16  # that bound a block
BLOCK = 512
SPLIT_BITS = 3  # an interval is split into 8
SLACK = 1e-9


def usable(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """(id, label, vector) that may link; equal rows once."""
    finite = F.forall(
        F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists(F.col(vector_col), lambda x: x != 0)
    return (
        vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite)
        .select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
        .withColumn("h1", F.xxhash64("label", "vector"))
        .withColumn("h2", F.xxhash64(F.lit(7), "vector", "label"))
    )


def _unit(rows) -> np.ndarray:
    """Double-precision unit vectors; scaled first, so that no square overflows."""
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(distinct: DataFrame, rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """Rotation for each vector length, fitted on the ``rows`` vectors of smallest hash."""
    sample = distinct.orderBy("h1", "h2").limit(rows).select("vector").toPandas()["vector"]
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    axes = {}
    for size, vs in by_size.items():
        x = _unit(vs)
        x = x - x.mean(0)
        _, basis = np.linalg.eigh(x.T @ x)
        axes[size] = basis[:, ::-1]
    return axes


def _located(axes: dict[int, np.ndarray], eps: float):
    """Cells on the leading dimensions, and the coordinates that bound blocks."""

    def run(frames):
        for frame in frames:
            frame["size"] = frame["vector"].map(len)
            for size, part in frame.groupby("size"):
                rotated = _unit(part["vector"]) @ axes.get(size, np.eye(size))[:, :BOX_DIMENSIONS]
                box = np.zeros((len(part), BOX_DIMENSIONS))
                box[:, : rotated.shape[1]] = rotated
                part = part.copy()
                for k in range(GRID_DIMENSIONS):
                    part[f"c{k}"] = np.floor(box[:, k] / eps).astype(np.int64)
                part["box"] = list(box)
                yield part

    return run


def _blocks(frames):
    """Cuts the sorted rows of a partition into blocks of one label and length."""
    number, filled, last = 0, 0, None
    for frame in frames:
        out = []
        for label, size in zip(frame["label"], frame["size"]):
            if (label, size) != last or filled == BLOCK:
                number, filled, last = number + 1, 0, (label, size)
            filled += 1
            out.append(number)
        frame["nth"] = out
        yield frame


def _joined(threshold: float):
    """Links inside one unit: counts per vector, and an edge to the smallest id of its component."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, weight, ids = _unit(frame["vector"]), frame["weight"].to_numpy(), frame["id"].to_numpy()
        if key[0] == key[1]:
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
        else:
            first = (frame["block"] == key[0]).to_numpy()
            linked = np.zeros((len(x), len(x)), bool)
            linked[np.ix_(first, ~first)] = x[first] @ x[~first].T >= threshold
            linked |= linked.T
        some = linked.any(1)
        linked, ids, weight = linked[np.ix_(some, some)], ids[some], weight[some]
        root = ids.copy()
        high = np.iinfo(np.int64).max
        while len(ids):
            lower = np.minimum(root, np.where(linked, root[None, :], high).min(1))
            if (lower == root).all():
                break
            root = lower
        return pd.DataFrame({"id": ids, "links": linked @ weight if len(ids) else weight, "root": root})

    return run


def _near_blocks(located: DataFrame, eps: float) -> DataFrame:
    """(a, b) block pairs, a <= b in their sequence, whose boxes are within eps."""
    sides = [f(f"{s}{k}").alias(f"{s}{k}") for k in range(BOX_DIMENSIONS) for s, f in (("lo", F.min), ("hi", F.max))]
    spread = located.select(
        "label", "size", "block", *[F.get("box", k).alias(f"{s}{k}") for k in range(BOX_DIMENSIONS) for s in ("lo", "hi")]
    )
    within = Window.partitionBy("label", "size").orderBy("block")
    blocks = written(
        spread.groupBy("label", "size", "block").agg(*sides).withColumn("seq", (F.row_number().over(within) - 1).cast("long")),
        "blocks",
    )
    most = blocks.agg(F.max("seq")).first()[0]
    if most is None:
        return blocks.select(F.col("block").alias("a"), F.col("block").alias("b"))
    levels = 0
    while most >> (SPLIT_BITS * levels):
        levels += 1

    def intervals(level: int) -> DataFrame:
        at = F.shiftright("seq", SPLIT_BITS * level)
        return blocks.groupBy("label", "size", at.alias("seq")).agg(*sides).withColumn("up", F.shiftright("seq", SPLIT_BITS))

    gap = sum(
        F.pow(F.greatest(F.col(f"x.lo{k}") - F.col(f"y.hi{k}"), F.col(f"y.lo{k}") - F.col(f"x.hi{k}"), F.lit(0.0)), F.lit(2.0))
        for k in range(BOX_DIMENSIONS)
    )
    pairs = intervals(levels).select("label", "size", F.col("seq").alias("a"), F.col("seq").alias("b"))
    for level in range(levels - 1, -1, -1):
        own = intervals(level)
        pairs = written(
            pairs.alias("p")
            .join(own.alias("x"), F.expr("p.label = x.label AND p.size = x.size AND p.a = x.up"))
            .join(own.alias("y"), F.expr("p.label = y.label AND p.size = y.size AND p.b = y.up AND x.seq <= y.seq"))
            .where(gap <= (eps + SLACK) ** 2)
            .select("x.label", "x.size", F.col("x.seq").alias("a"), F.col("y.seq").alias("b")),
            "interval-pairs",
        )
    name = blocks.select("label", "size", "seq", "block")
    first = name.select("label", "size", F.col("seq").alias("a"), F.col("block").alias("first"))
    second = name.select("label", "size", F.col("seq").alias("b"), F.col("block").alias("second"))
    return (
        pairs.join(first, ["label", "size", "a"])
        .join(second, ["label", "size", "b"])
        .select(F.col("first").alias("a"), F.col("second").alias("b"))
    )


def link(
    vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    eps = float(np.sqrt(2 - 2 * threshold))
    rows = usable(vectors, id_col, vector_col, label_col)
    same = rows.groupBy("h1", "h2", "label", "vector").agg(F.min("id").alias("id"), F.count_distinct("id").alias("weight"))
    distinct = written(same, "vectors")
    kind = dict(distinct.dtypes)
    cells = [f"c{k}" for k in range(GRID_DIMENSIONS)]
    schema = (
        f"id long, label {kind['label']}, vector {kind['vector']}, weight long, size long, "
        + ", ".join(f"{c} long" for c in cells)
        + ", box array<double>"
    )
    placed = distinct.select("id", "label", "vector", "weight").mapInPandas(_located(principal_axes(distinct), eps), schema)
    order = ["label", "size", *cells, "id"]
    # the rows per range keep a range, hence a task, at a few blocks
    ranges = max(8, -(-distinct.count() // (8 * BLOCK)))
    cut = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    cut = cut.withColumn("range", F.spark_partition_id())
    numbered = cut.mapInPandas(_blocks, _schema_with(cut, "nth long"))
    located = written(
        numbered.withColumn("block", F.col("range").cast("long") * F.lit(2**32) + F.col("nth")).drop("range", "nth"), "ego"
    )
    pairs = written(_near_blocks(located, eps), "block-pairs")
    lean = located.select("id", "vector", "weight", "block")
    left = lean.join(pairs, lean["block"] == pairs["a"])
    right = lean.join(pairs.where("a <> b"), lean["block"] == F.col("b"))
    units = left.unionByName(right).groupBy("a", "b").applyInPandas(_joined(threshold), "id long, links long, root long")
    links = written(units, "links")
    classes = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = (
        distinct.select("h1", "h2", "id", "weight")
        .join(counts, "id", "left")
        .join(classes.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "h1", "h2",
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    member = rows.select("id", "h1", "h2").distinct().join(known, ["h1", "h2"]).select(
        F.col("id").alias("__id"), "h1", "h2", "n_links", "component_id"
    )
    every = vectors.select(
        F.col(id_col).alias("vec_id"),
        F.xxhash64(label_col, vector_col).alias("h1"),
        F.xxhash64(F.lit(7), vector_col, label_col).alias("h2"),
    )
    joined = every.join(member, (every["vec_id"] == member["__id"]) & (every["h1"] == member["h1"]) & (every["h2"] == member["h2"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _schema_with(df: DataFrame, more: str) -> str:
    """Schema of ``df`` with more columns, as text."""
    return ", ".join([*[f"{n} {t}" for n, t in df.dtypes], more])
