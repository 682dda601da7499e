"""Exact nearest neighbours over stored vectors.

Distances are matrix products over blocks, inside tasks; only the best ``k`` rows per query leave a
block, and a per-query ranking over those gives the exact answer. Pairs of vectors are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.core.ranking import ranked
from mealgrid.core.scratch import written
from mealgrid.functions import fixed_values as fixed

COSINE, L2, INNER = "cosine", "l2", "inner_product"
SMALL_QUERIES = 2_048
BLOCK_DOCS = 20_000
CELLS_PER_BLOCK, MOST_CELLS = 4, 1_024
_FOUND = "query_id bigint, doc_id bigint, distance double"


def distance_to_score(distance: Column, metric: str) -> Column:
    """Similarity from distance: cosine 1-d, l2 1/(1+d), inner product -d."""
    if metric == COSINE:
        return F.lit(1.0) - distance
    if metric == L2:
        return F.lit(1.0) / (F.lit(1.0) + distance)
    return -distance


def vector_literal(column: Column) -> Column:
    """Vector as text with seven significant digits per value."""
    values = F.transform(column, lambda v: F.format_string("%.7g", v.cast("double")))
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def wrong_dimensions(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """Vectors whose length is not ``size``."""
    return vectors.filter(F.size(column) != size)


def _distances(queries: np.ndarray, docs: np.ndarray, metric: str) -> np.ndarray:
    if metric == L2:
        return np.stack([np.sqrt(((docs - q) ** 2).sum(axis=1)) for q in queries])
    product = queries @ docs.T
    if metric == INNER:
        return -product
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(docs, axis=1)[None, :]
    return 1.0 - product / norms


def _best(query_ids: np.ndarray, queries: np.ndarray, doc_ids: np.ndarray, docs: np.ndarray, k: int, metric: str):
    distances = _distances(queries, docs, metric)
    rows = []
    for position, query_id in enumerate(query_ids):
        order = np.lexsort((doc_ids, distances[position]))[:k]
        rows.append(
            pd.DataFrame({"query_id": query_id, "doc_id": doc_ids[order], "distance": distances[position][order]})
        )
    return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _against_few(queries: DataFrame, docs: DataFrame, k: int, metric: str) -> DataFrame:
    rows = queries.toPandas()
    ids, matrix = rows["query_id"].to_numpy(np.int64), _matrix(rows["embedding"])
    shared = docs.sparkSession.sparkContext.broadcast((ids, matrix))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_matrix = shared.value
        for batch in batches:
            if len(batch) and len(query_ids):
                yield _best(
                    query_ids, query_matrix, batch["doc_id"].to_numpy(np.int64), _matrix(batch["embedding"]), k, metric
                )

    return docs.mapInPandas(scan, _FOUND)


class _Cells:
    """Documents dealt to the nearest of some pivots, and what each cell promises a query without being read.

    With ``gap`` the length of (document - pivot), the distance of a query to a document differs from its distance to the pivot
    by at most ``slack * gap``: the triangle inequality for l2 (slack 1), and Cauchy-Schwarz for the products, where the slack is
    the length of the query. Vectors are brought to length 1 first for the cosine.
    """

    def __init__(self, pivots: np.ndarray, metric: str):
        self.pivots, self.metric = pivots, metric
        self.radius = self.nearest = None

    def unit(self, rows: np.ndarray) -> np.ndarray:
        if self.metric != COSINE:
            return rows
        with np.errstate(all="ignore"):
            return rows / np.linalg.norm(rows, axis=1)[:, None]

    def place(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, gap) of each document; where no gap can be told it is infinite."""
        docs = self.unit(docs)
        gaps = np.stack([np.linalg.norm(docs - pivot, axis=1) for pivot in self.pivots], axis=1)
        gaps[~np.isfinite(gaps)] = np.inf
        cell = gaps.argmin(axis=1)
        return cell, gaps[np.arange(len(docs)), cell]

    def summarise(self, rows, k: int) -> None:
        """Takes (cell, rank, gap, radius): the ``k`` smallest gaps of each cell and its largest."""
        self.radius = np.full(len(self.pivots), -np.inf)
        self.nearest = np.full((len(self.pivots), k), np.inf)
        for cell, rank, gap, radius in rows:
            self.nearest[cell, rank - 1], self.radius[cell] = gap, radius

    def wanted(self, query: np.ndarray) -> np.ndarray:
        """Cells that may hold one of the ``k`` nearest documents of a query."""
        query = self.unit(query[None, :])[0]
        slack = 1.0 if self.metric == L2 else float(np.linalg.norm(query))
        base = np.linalg.norm(self.pivots - query, axis=1) if self.metric == L2 else -(self.pivots @ query)
        with np.errstate(all="ignore"):
            at_most = np.sort((base[:, None] + slack * self.nearest).ravel())[self.nearest.shape[1] - 1]
            at_least = base - slack * self.radius
        # rounding must not lose a document, and what cannot be told is looked at
        margin = 1e-9 * (1.0 + np.abs(base) + slack)
        return np.flatnonzero((self.radius > -np.inf) & ~(at_least - margin > at_most))


def _in_cells(queries: DataFrame, docs: DataFrame, k: int, metric: str, small: int, block: int) -> DataFrame:
    """Every document travels to its cell once; a query goes only to cells that may hold one of its ``k`` nearest."""
    n_docs = docs.count()
    n_cells = max(1, min(MOST_CELLS, CELLS_PER_BLOCK * -(-n_docs // block)))
    # pivots only decide how much is pruned: any documents will do, and their number is bounded
    drawn = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_cells).toPandas()
    empty = queries.select("query_id", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("double").alias("distance")).where("false")
    if not len(drawn):
        return empty
    pivots = _Cells(np.zeros((0, 0)), metric).unit(_matrix(drawn["embedding"]))
    cells = _Cells(pivots[np.isfinite(pivots).all(axis=1)], metric)
    if not len(cells.pivots):
        cells.pivots = np.zeros((1, pivots.shape[1]))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, gap = cells.place(_matrix(batch["embedding"]))
                yield batch.assign(cell=cell.astype(np.int32), gap=gap)

    dealt = written(docs.mapInPandas(placed, f"{_ddl(docs)}, cell int, gap double"), "placed-vectors")
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    sizes = {r.cell: (r.n, r.radius) for r in sizes.collect()}  # one row per cell
    near = ranked(dealt.select("cell", "gap", "doc_id"), ["cell"], [F.col("gap").asc(), F.col("doc_id").asc()], k, "rank")
    cells.summarise([(r.cell, r["rank"], r.gap, sizes[r.cell][1]) for r in near.collect()], k)  # k rows per cell

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [cells.wanted(v) for v in _matrix(batch["embedding"])] if len(batch) else []
            rows = batch.loc[batch.index.repeat([len(f) for f in found])] if found else batch
            yield rows.assign(cell=np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))

    asked = written(queries.mapInPandas(sent, f"{_ddl(queries)}, cell int"), "sent-queries")
    asking = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}
    # a cell is cut into parts of at most ``block`` documents and ``small`` queries
    doc_parts = {c: -(-n // block) for c, (n, _) in sizes.items()}
    query_parts = {c: -(-n // small) for c, n in asking.items()}

    def cut(df: DataFrame, own: dict, mine: str, other: dict, theirs: str, key: str) -> DataFrame:
        count = lambda parts: F.get(F.array(*[F.lit(parts.get(c, 1)) for c in range(len(cells.pivots))]), F.col("cell"))
        return df.withColumn(mine, F.pmod(F.xxhash64(key), count(own)).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), count(other) - 1))
        )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
        return _best(
            left["query_id"].to_numpy(np.int64), _matrix(left["embedding"]), right["doc_id"].to_numpy(np.int64),
            _matrix(right["embedding"]), k, metric,
        )

    keys = ["cell", "qb", "db"]
    q = cut(asked, query_parts, "qb", doc_parts, "db", "query_id").groupBy(*keys)
    d = cut(dealt.drop("gap"), doc_parts, "db", query_parts, "qb", "doc_id").groupBy(*keys)
    return q.cogroup(d).applyInPandas(meet, _FOUND)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def vector_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int = fixed.TOP_K,
    floor: float = fixed.SCORE_FLOOR,
    metric: str = COSINE,
    small: int = SMALL_QUERIES,
    block: int = BLOCK_DOCS,
) -> DataFrame:
    """(query_id, doc_id, distance, score, rank): the ``k`` nearest documents per query, then a score floor.

    ``queries`` has (query_id, embedding), ``docs`` (doc_id, embedding); rows without a vector are
    skipped. Up to ``small`` queries (counted first) are sent to every task and the documents are
    read once. Beyond that documents are dealt to cells around pivots, and a query meets only the cells
    that can hold one of its ``k`` nearest; both ways are exact.
    """
    q = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    d = docs.select("doc_id", "embedding").filter(F.col("embedding").isNotNull())
    n_queries = q.limit(small + 1).count()
    if n_queries <= small:
        found = _against_few(q, d, k, metric)
    else:
        found = _in_cells(q, d, k, metric, small, block)
    best = ranked(found, ["query_id"], [F.col("distance").asc(), F.col("doc_id").asc()], k, "rank")
    return best.withColumn("score", distance_to_score(F.col("distance"), metric)).filter(F.col("score") >= floor)


# ---------------------------------------------------------------- retrieval around the search


def route_question(question: Column) -> Column:
    """Which table a question is about: product words first, then ingredient words, else recipes."""
    return (
        F.when(question.rlike(fixed.PRODUCT_HINTS), "product")
        .when(question.rlike(fixed.INGREDIENT_HINTS), "ingredient")
        .otherwise("recipe")
    )


def with_evidence(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with ``has_evidence``; without any document no text is to be generated."""
    found = hits.select("query_id").distinct().withColumn("has_evidence", F.lit(True))
    return questions.join(found, "query_id", "left").withColumn(
        "has_evidence", F.coalesce("has_evidence", F.lit(False))
    )


def context_texts(questions: DataFrame, hits: DataFrame, lines: Column) -> DataFrame:
    """One context text per question: its at most ``k`` document lines in rank order."""
    entries = F.array_sort(F.collect_list(F.struct("rank", lines.alias("line"))))
    texts = hits.groupBy("query_id").agg(
        F.array_join(F.transform(entries, lambda e: e["line"]), "\n").alias("context")
    )
    return questions.join(texts, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(fixed.NO_EVIDENCE))
    )


def hit_flags(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Cases (query_id, expected_doc_id rows) → (query_id, hit): any expected document found.

    Only questions that expect documents appear.
    """
    good = (
        cases.join(hits.select("query_id", F.col("doc_id").alias("expected_doc_id")), ["query_id", "expected_doc_id"],
                   "left_semi")
        .select("query_id")
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    return cases.select("query_id").distinct().join(good, "query_id", "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def body_covers(embedded: DataFrame, shown: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """(keys, covers): whether every embedded field of a document also stands in the body that is shown."""
    present = shown.select(*keys, field).distinct().withColumn("present", F.lit(True))
    return (
        embedded.select(*keys, field)
        .join(present, [*keys, field], "left")
        .groupBy(*keys)
        .agg(F.bool_and(F.col("present").isNotNull()).alias("covers"))
    )
