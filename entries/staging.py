"""Staging rows from records built over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.binding import table, view
from entries.registry import Registry, joined
from mealgrid.plans import staging

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


@register(
    "keep_first_rows",
    "SELECT p_name, p_type, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1, 2",
)
def keep_first_rows(spark, sf):
    rows = table(spark, sf, "part").withColumn("ordinal", F.col("p_partkey"))
    return staging.keep_first(rows, ["p_name", "p_type"]).select("p_name", "p_type", "p_brand")


@register(
    "unique_sku",
    """SELECT p_partkey, CASE WHEN p_size > 5 AND row_number() OVER (PARTITION BY p_name, p_size > 5 ORDER BY p_partkey) = 1 THEN p_name END AS sku FROM part""",
)
def unique_sku(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "p_partkey AS ordinal", "CASE WHEN p_size > 5 THEN p_name END AS sku")
    return staging.unique_sku(rows).select("p_partkey", "sku")


@register(
    "category_staging_rows",
    """WITH r AS (SELECT *, CASE WHEN p_size > 25 THEN p_brand || ' > ' ELSE '' END || p_type AS path FROM part WHERE p_size <> 7)
SELECT path, arg_min(CASE WHEN p_size > 25 THEN p_brand ELSE '' END, p_partkey) AS parent_path, p_type AS name,
  arg_min(CASE WHEN p_size % 2 = 0 THEN p_size WHEN p_size > 25 THEN 1 ELSE 0 END, p_partkey) AS depth,
  arg_min(CASE WHEN p_size % 3 = 0 THEN 'meta' ELSE 'column' END, p_partkey) AS source FROM r GROUP BY path, p_type""",
)
def category_staging_rows(spark, sf):
    raw = view(spark, sf, """SELECT 'PRODUCT' AS category_type, CASE WHEN p_size = 7 THEN 'none' ELSE p_type END AS name,
      CASE WHEN p_size > 25 THEN p_brand ELSE '-' END AS parent_path, CASE WHEN p_size % 2 = 0 THEN p_size END AS depth,
      CASE WHEN p_size % 3 = 0 THEN '{{"source": "meta"}}' ELSE 'nan' END AS metadata, 'column' AS source,
      'c1' AS source_code, CAST(NULL AS BOOLEAN) AS is_edible, p_partkey AS ordinal FROM {part}""")
    rows = staging.category_rows(raw)
    return rows.select("path", "parent_path", "name", "depth", F.get_json_object("metadata", "$.source").alias("source"))


@register(
    "product_ingredient_rows",
    """SELECT CAST(p_partkey AS VARCHAR) AS source_product_id, lower(p_type) AS normalized_name, CASE WHEN p_size % 2 = 0 THEN 'SECONDARY' ELSE 'PRIMARY' END AS role,
  CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS quantity_g FROM part WHERE p_size % 5 <> 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), lower(replace(p_name, ' ', '')), 'PRIMARY', NULL FROM part WHERE p_size % 5 <> 0""",
)
def product_ingredient_rows(spark, sf):
    raw = view(spark, sf, """SELECT 'shop' AS source_type, CAST(p_partkey AS STRING) AS source_product_id, p_partkey AS ordinal,
      CASE WHEN p_size % 5 = 0 THEN 'broken' WHEN p_size % 2 = 0 THEN concat('[{{"name": "', p_type, '", "role": "SECONDARY", "quantity_g": ', p_size, '}}, "', p_name, '", "', upper(p_type), '"]')
        ELSE concat('["', p_type, '", {{"normalized_name": "', p_name, '"}}, " "]') END AS ingredients FROM {part}""")
    rows = staging.product_ingredient_rows(raw)
    return rows.select("source_product_id", "normalized_name", "role", F.col("quantity_g").cast("double").alias("quantity_g"))


RECORDS = """SELECT CAST(l_orderkey AS STRING) AS source_recipe_id, concat(' Recipe ', l_orderkey, ' ') AS name, CAST(NULL AS STRING) AS description,
  CASE WHEN max(o_orderstatus) = 'F' THEN 'Original' ELSE ' ' END AS name_original, max(o_orderpriority) AS difficulty, 10 AS cook_time_min,
  '오븐 구이' AS cooking_method, map('kcal', CAST(1 AS DOUBLE), 'fat', CAST(NULL AS DOUBLE)) AS nutrition, array(' tag ', '') AS tags,
  array_sort(collect_list(struct(l_partkey AS k, l_linenumber AS n, l_extendedprice AS e, p_name AS raw_text, p_name AS name,
    CASE WHEN l_tax > 0.05 THEN 'unknown thing' ELSE upper(p_name) END AS normalized_name, l_returnflag <> 'R' AS is_required))) AS ingredients,
  array_sort(collect_list(struct(l_partkey AS k, l_linenumber AS n, l_extendedprice AS e,
    CASE WHEN l_discount > 0.03 THEN concat(' do ', l_linenumber) ELSE ' ' END AS instruction, CASE WHEN l_discount < 0.01 THEN 'img' END AS image_url))) AS steps
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey"""
MATCHES = "SELECT DISTINCT lower(replace(p_name, ' ', '')) AS normalized_name, 1L AS ingredient_id FROM {part}"
RATES_SQL = """rates AS (SELECT l_orderkey, max(o_orderstatus) AS st, avg(CASE WHEN l_tax > 0.05 THEN 0.0 ELSE 1.0 END) AS rate FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)"""


def _records(spark, sf):
    return view(spark, sf, RECORDS), view(spark, sf, MATCHES)


@register(
    "match_rates",
    f"WITH {RATES_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS source_recipe_id, round(rate, 6)::DOUBLE AS match_rate FROM rates",
)
def match_rates(spark, sf):
    return staging.match_rates(*_records(spark, sf)).withColumn("match_rate", F.round("match_rate", 6))


@register(
    "loadable_records",
    f"WITH {RATES_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS source_id, 'Recipe ' || l_orderkey AS name, '굽기' AS cooking_method, 'tag' AS tags, 1 AS nutrition_size FROM rates WHERE st <> 'F' OR rate >= 0.7",
)
def loadable_records(spark, sf):
    rows = staging.recipe_rows(staging.loadable_records(*_records(spark, sf)))
    return rows.select("source_id", "name", "cooking_method", joined("tags"), F.size("nutrition").alias("nutrition_size"))


@register(
    "recipe_line_rows",
    """SELECT CAST(l_orderkey AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_extendedprice) AS line_no,
  CASE WHEN l_tax > 0.05 THEN 'unknownthing' ELSE lower(replace(p_name, ' ', '')) END AS normalized_name, l_tax <= 0.05 AS known
FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def recipe_line_rows(spark, sf):
    rows = staging.recipe_line_rows(*_records(spark, sf))
    return rows.select("source_id", "line_no", "normalized_name", "known")


@register(
    "recipe_step_rows",
    """SELECT CAST(l_orderkey AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_extendedprice) AS step_no,
  CASE WHEN l_discount > 0.03 THEN 'do ' || l_linenumber END AS instruction FROM lineitem WHERE l_discount > 0.03 OR l_discount < 0.01""",
)
def recipe_step_rows(spark, sf):
    return staging.recipe_step_rows(_records(spark, sf)[0]).select("source_id", "step_no", "instruction")


ITEMS = """SELECT CAST(l_orderkey AS STRING) AS source_item_id, min(CASE WHEN l_partkey % 4 = 0 THEN 'nothing known' ELSE upper(p_name) END) AS normalized_name,
  array_sort(collect_list(struct(CASE l_returnflag WHEN 'A' THEN 'pantry' WHEN 'N' THEN ' freeze ' ELSE 'dop_refrigerate' END AS source_slot, l_partkey AS k, l_linenumber AS n,
    CAST(l_quantity AS INT) AS duration_min, CASE WHEN l_tax > 0.02 THEN CAST(l_quantity AS INT) + 1 END AS duration_max, 'Days' AS duration_unit,
    CASE WHEN l_discount > 0.02 THEN concat(CAST(l_quantity AS INT), ' days ') ELSE ' ' END AS duration_text))) AS rules
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey"""
ITEMS_SQL = """items AS (SELECT l_orderkey, min(CASE WHEN l_partkey % 4 = 0 THEN 'nothing known' ELSE upper(p_name) END) AS nm FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"""


@register(
    "storage_rule_rows",
    f"""WITH {ITEMS_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS source_item_id, CASE l_returnflag WHEN 'A' THEN '상온' WHEN 'N' THEN '냉동' ELSE '냉장' END AS storage_location,
  CASE l_returnflag WHEN 'R' THEN '구매후' ELSE '일반' END AS storage_context, CASE WHEN l_tax > 0.02 THEN CAST(l_quantity AS INTEGER) END AS duration_min,
  CASE WHEN l_tax > 0.02 THEN '일' END AS duration_unit, CAST(l_quantity AS INTEGER) || ' days' AS duration_text
FROM lineitem JOIN items USING (l_orderkey) WHERE nm <> 'nothing known' AND l_discount > 0.02""",
)
def storage_rule_rows(spark, sf):
    rows = staging.storage_rule_rows(view(spark, sf, ITEMS), view(spark, sf, MATCHES))
    return rows.select("source_item_id", "storage_location", "storage_context", "duration_min", "duration_unit", "duration_text")


@register(
    "skipped_storage_rules",
    f"WITH {ITEMS_SQL} SELECT count(*) AS skipped FROM lineitem JOIN items USING (l_orderkey) WHERE nm = 'nothing known'",
)
def skipped_storage_rules(spark, sf):
    return staging.skipped_rules(view(spark, sf, ITEMS), view(spark, sf, MATCHES))


@register(
    "build_entities",
    """SELECT c_custkey || '|' || c_mktsegment AS entity_key, 1::BIGINT AS own_rows, coalesce(n, 0) AS companion_rows FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey""",
)
def build_entities(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    placed = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    placed = placed.join(customers.selectExpr("c_custkey AS o_custkey", "c_mktsegment AS s"), "o_custkey").selectExpr(
        "concat(' ', o_custkey, '|', s) AS key", "o_orderkey"
    )
    rows = staging.build_entities(customers, ["c_custkey", "c_mktsegment"], F.col("c_custkey"), {"orders": (placed, "key")})
    return rows.groupBy("entity_key").agg(
        F.sum(F.coalesce(F.size("rows"), F.lit(0))).alias("own_rows"),
        F.sum(F.coalesce(F.size("orders"), F.lit(0))).alias("companion_rows"),
    )


@register(
    "build_entities_one",
    """SELECT CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN CAST(o_custkey AS VARCHAR) ELSE o_custkey || '#' || o_orderkey END AS entity_key,
  o_orderkey, 1::BIGINT AS own_rows FROM orders""",
)
def build_entities_one(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    rows = staging.build_entities(orders, ["o_custkey"], F.col("o_orderkey"), {}, one=True)
    own = F.get("rows", F.lit(0))["o_orderkey"].alias("o_orderkey")
    return rows.select("entity_key", own, F.size("rows").cast("bigint").alias("own_rows"))


@register(
    "target_shapes",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'storage' WHEN 'O' THEN 'recipe' END AS shape FROM orders",
)
def target_shapes(spark, sf):
    targets = (
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("recipe"), F.lit("storage_guideline")))
        .when(F.col("o_orderstatus") == "O", F.array(F.lit("none"), F.lit("recipe")))
        .otherwise(F.array(F.lit("none")))
    )
    return table(spark, sf, "orders").select("o_orderkey", staging.target_shape(targets).alias("shape"))
