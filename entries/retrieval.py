"""Vector search: the mean vector of every label as a query against all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.binding import bind, table, view
from entries.registry import Registry
from mealgrid.functions.reasons import context_line
from mealgrid.operators import vectors
from mealgrid.plans import documents, reports

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

VECTORS_SQL = """pos AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT label, i, avg(v) AS v FROM pos GROUP BY 1, 2),
pairs AS (SELECT c.label AS query_id, p.vec_id AS doc_id, any_value(p.label) AS doc_label, sum(c.v * p.v) AS dot, sqrt(sum((c.v - p.v) * (c.v - p.v))) AS l2,
  1 - sum(c.v * p.v) / (sqrt(sum(c.v * c.v)) * sqrt(sum(p.v * p.v))) AS cos FROM centre c JOIN pos p ON p.i = c.i GROUP BY 1, 2)
"""


def _queries(spark, sf):
    """Mean vector per label, as arrays in dimension order (one entry per dimension)."""
    means = (
        table(spark, sf, "embeddings")
        .select("label", F.posexplode("embedding").alias("i", "v"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("v").cast("double")).alias("v"))
    )
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("embedding")
    )


def _docs(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _hits(spark, sf, metric, k=5, floor=-1e9):
    rows = vectors.vector_topk(_queries(spark, sf), _docs(spark, sf), k, floor, metric)
    return rows


def _topk_sql(distance: str, score: str, k: int, floor: str) -> str:
    return f"""WITH {VECTORS_SQL} SELECT query_id, doc_id, round(d, 6) AS distance, round(s, 6) AS score, rank FROM (
SELECT query_id, doc_id, {distance} AS d, {score} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {distance}, doc_id) AS rank FROM pairs)
WHERE rank <= {k} AND s >= {floor}"""


def _rounded(rows):
    return rows.select("query_id", "doc_id", F.round("distance", 6).alias("distance"),
                       F.round("score", 6).alias("score"), "rank")


@register("vector_topk_cosine", _topk_sql("cos", "1 - cos", 5, "0.33"))
def vector_topk_cosine(spark, sf):
    return _rounded(_hits(spark, sf, vectors.COSINE, 5, 0.33))


@register("vector_topk_l2", _topk_sql("l2", "1 / (1 + l2)", 7, "-1"))
def vector_topk_l2(spark, sf):
    return _rounded(_hits(spark, sf, vectors.L2, 7))


@register("vector_topk_inner", _topk_sql("-dot", "dot", 4, "-1e9"))
def vector_topk_inner(spark, sf):
    return _rounded(_hits(spark, sf, vectors.INNER, 4))


@register("vector_literals", "SELECT vec_id, len(embedding) AS dimensions, round(embedding[1]::DOUBLE, 4) AS first_value FROM embeddings")
def vector_literals(spark, sf):
    text = vectors.vector_literal(F.col("embedding"))
    values = F.from_json(text, "array<double>")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.size(values).cast("bigint").alias("dimensions"), F.round(values[0], 4).alias("first_value")
    )


@register("wrong_dimensions", "SELECT vec_id FROM embeddings WHERE embedding[1] > 0")
def wrong_dimensions(spark, sf):
    cut = table(spark, sf, "embeddings").withColumn(
        "embedding", F.when(F.col("embedding")[0] > 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    )
    return vectors.wrong_dimensions(cut, "embedding", 64).select("vec_id")


ROUTED_SQL = """SELECT l_orderkey AS case_id, CASE WHEN max(l_tax) > 0.07 THEN '가격이 얼마' WHEN max(l_discount) > 0.08 THEN '보관 방법' ELSE '오늘 저녁' END AS question FROM lineitem GROUP BY 1"""


@register(
    "routed_questions",
    """SELECT l_orderkey AS case_id, CASE WHEN max(l_tax) > 0.07 THEN 'product' WHEN max(l_discount) > 0.08 THEN 'ingredient' ELSE 'recipe' END AS route FROM lineitem GROUP BY 1""",
)
def routed_questions(spark, sf):
    questions = view(spark, sf, ROUTED_SQL.replace("FROM lineitem GROUP BY 1", "FROM {lineitem} GROUP BY l_orderkey"))
    return questions.select("case_id", vectors.route_question(F.col("question")).alias("route"))


@register(
    "evidence_flags",
    f"""WITH {VECTORS_SQL} SELECT label AS query_id, coalesce(label IN (SELECT query_id FROM (SELECT query_id, cos, row_number() OVER (PARTITION BY query_id ORDER BY cos, doc_id) AS r FROM pairs)
  WHERE r <= 5 AND 1 - cos >= 0.4), false) AS has_evidence FROM (SELECT DISTINCT CAST(label AS BIGINT) AS label FROM embeddings)""",
)
def evidence_flags(spark, sf):
    queries = _queries(spark, sf)
    return vectors.with_evidence(queries.select("query_id"), _hits(spark, sf, vectors.COSINE, 5, 0.4))


@register(
    "context_texts",
    f"""WITH {VECTORS_SQL}, top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cos, doc_id) AS r FROM pairs),
best AS (SELECT t.*, r.name, concat_ws(' / ', r.description, l.names, r.cooking_method || ', ' || r.difficulty, r.cooking_method) AS body FROM top t JOIN recipe r ON r.recipe_id = t.doc_id
  LEFT JOIN (SELECT recipe_id, string_agg(i.name, ', ' ORDER BY ri.is_required DESC, i.name, i.ingredient_id) AS names
  FROM recipe_ingredient ri JOIN ingredient i USING (ingredient_id) GROUP BY 1) l ON l.recipe_id = t.doc_id WHERE r <= 3)
SELECT query_id, string_agg('[recipe#' || doc_id || '] ' || name || CASE WHEN body <> '' THEN ' - ' || body ELSE '' END, chr(10) ORDER BY r) AS context FROM best GROUP BY 1""",
)
def context_texts(spark, sf):
    bodies = documents.recipe_body(bind(spark, sf))
    hits = _hits(spark, sf, vectors.COSINE, 3).join(bodies, "doc_id")
    line = context_line(F.col("source"), F.col("doc_id"), F.col("title"), F.col("body"))
    return vectors.context_texts(_queries(spark, sf).select("query_id"), hits, line)


@register(
    "retrieval_metrics",
    f"""WITH {VECTORS_SQL}, top AS (SELECT query_id, doc_id, doc_label, row_number() OVER (PARTITION BY query_id ORDER BY cos, doc_id) AS r FROM pairs),
h AS (SELECT query_id, bool_or(doc_label = query_id) AS hit FROM top WHERE r <= 5 GROUP BY 1)
SELECT avg(CASE WHEN query_id < 5 THEN (query_id % 2)::INTEGER END) AS route_accuracy, avg(hit::INTEGER) AS hit_rate, avg(query_id * 10.0::DOUBLE) AS mean_latency_ms FROM h""",
)
def retrieval_metrics(spark, sf):
    hits = _hits(spark, sf, vectors.COSINE, 5)
    expected = _docs(spark, sf).select(F.col("label").cast("bigint").alias("query_id"), F.col("doc_id").alias("expected_doc_id"))
    flags = vectors.hit_flags(expected, hits)
    results = flags.withColumns(
        {
            "route": F.when(F.col("query_id") % 2 == 1, "recipe").otherwise("product"),
            "expected_route": F.when(F.col("query_id") < 5, "recipe"),
            "elapsed_ms": F.col("query_id") * 10.0,
        }
    )
    return reports.route_metrics(results)


@register(
    "body_covers",
    """SELECT ri.recipe_id, bool_and(NOT i.is_pantry) AS covers FROM recipe_ingredient ri JOIN ingredient i USING (ingredient_id)
WHERE ri.is_required GROUP BY 1""",
)
def body_covers(spark, sf):
    catalog = bind(spark, sf)
    lines = catalog.recipe_ingredient.join(catalog.ingredient.select("ingredient_id", "is_pantry"), "ingredient_id")
    field = lines.withColumn("field", F.col("ingredient_id"))
    return vectors.body_covers(field.filter("is_required"), field.filter("NOT is_pantry"), ["recipe_id"])
