"""Table maintenance over the given tables: what existed before a date meets what came in since another."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.binding import AS_OF, bind, storage_staging, table, view
from entries.registry import Registry, joined, num, stamp, stamp_sql
from mealgrid.core import merge
from mealgrid.plans import loading

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

# ---------------------------------------------------------------- recipes

TARGET_RECIPE = """SELECT o_orderkey AS recipe_id, o_orderstatus AS source_type, CAST(o_orderkey AS STRING) AS source_recipe_id,
  concat('old ', o_orderkey) AS name, o_orderpriority AS difficulty, CAST(o_custkey % 50 AS INT) AS cook_time_min,
  '{{"kcal":1}}' AS nutrition, array('old', o_orderpriority) AS tags
FROM {orders} WHERE o_orderdate < TIMESTAMP_NTZ'1998-01-01'"""
STAGED_RECIPE = """SELECT o_orderstatus AS source_type, CAST(o_orderkey AS STRING) AS source_recipe_id, concat('new ', o_orderkey) AS name,
  CASE WHEN o_totalprice > 200000 THEN 'hard' END AS difficulty, CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 20 AS INT) END AS cook_time_min,
  CASE WHEN o_totalprice > 300000 THEN '{{"kcal":2}}' ELSE '{{}}' END AS nutrition,
  CASE WHEN o_custkey % 2 = 0 THEN array('new') ELSE CAST(array() AS ARRAY<STRING>) END AS tags
FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ'1996-01-01'"""


@register(
    "upsert_recipes",
    """SELECT coalesce(t.st, s.st) AS source_type, coalesce(t.id, s.id) AS source_recipe_id,
  coalesce(s.name, t.name) AS name, coalesce(s.difficulty, t.difficulty) AS difficulty,
  coalesce(s.cook, t.cook) AS cook_time_min,
  CASE WHEN t.id IS NULL THEN s.nutrition WHEN s.nutrition = '{}' OR s.id IS NULL THEN t.nutrition ELSE s.nutrition END AS nutrition,
  CASE WHEN t.id IS NULL THEN s.tags WHEN s.tags = '' OR s.id IS NULL THEN t.tags ELSE s.tags END AS tags,
  CASE WHEN t.id IS NULL THEN 'inserted' WHEN s.id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM (SELECT o_orderstatus AS st, CAST(o_orderkey AS VARCHAR) AS id, 'old ' || o_orderkey AS name, o_orderpriority AS difficulty,
        CAST(o_custkey % 50 AS INTEGER) AS cook, '{"kcal":1}' AS nutrition, 'old|' || o_orderpriority AS tags
      FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') t
FULL JOIN (SELECT o_orderstatus AS st, CAST(o_orderkey AS VARCHAR) AS id, 'new ' || o_orderkey AS name,
        CASE WHEN o_totalprice > 200000 THEN 'hard' END AS difficulty,
        CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 20 AS INTEGER) END AS cook,
        CASE WHEN o_totalprice > 300000 THEN '{"kcal":2}' ELSE '{}' END AS nutrition,
        CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE '' END AS tags
      FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') s ON t.st = s.st AND t.id = s.id""",
)
def upsert_recipes(spark, sf):
    merged = loading.upsert_recipes(view(spark, sf, TARGET_RECIPE), view(spark, sf, STAGED_RECIPE))
    return merged.drop("recipe_id").withColumn("tags", joined("tags"))


STAGED_LINES = """SELECT CAST('web' AS STRING) AS source_type, CAST(l_orderkey AS STRING) AS source_id, l_linenumber AS line_no,
  concat('n', floor(l_partkey / 6)) AS normalized_name, CASE WHEN l_tax > 0.02 THEN CAST(l_quantity AS DECIMAL(10,3)) END AS quantity,
  CASE WHEN l_discount > 0.03 THEN 'ml' END AS unit, l_returnflag <> 'R' AS is_required, CAST(NULL AS STRING) AS purpose,
  l_extendedprice AS price
FROM {lineitem} WHERE l_shipdate >= TIMESTAMP_NTZ'1996-01-01'"""


def _staged_lines(spark, sf):
    # the pair (order, line number) repeats in the given table: number lines by price within the pair
    lines = view(spark, sf, STAGED_LINES)
    return lines.withColumn("line_no", F.col("line_no") * F.lit(10_000_000.0) + F.col("price")).drop("price")


def _matches(spark, sf):
    return view(spark, sf, """SELECT DISTINCT concat('n', floor(p_partkey / 6)) AS normalized_name,
        CAST(floor(p_partkey / 6) AS BIGINT) AS ingredient_id FROM {part}""")


DEDUPED_LINES = """SELECT l_orderkey AS recipe_id, l_partkey // 6 AS ingredient_id,
   CASE WHEN l_tax > 0.02 THEN l_quantity END AS quantity, CASE WHEN l_discount > 0.03 THEN 'ml' END AS unit,
   l_returnflag <> 'R' AS is_required
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey // 6 ORDER BY l_returnflag <> 'R' DESC,
        l_linenumber * 10000000.0::DOUBLE + l_extendedprice) = 1"""


@register("one_line_per_ingredient", DEDUPED_LINES)
def one_line_per_ingredient(spark, sf):
    rows = loading.one_line_per_ingredient(_staged_lines(spark, sf), _matches(spark, sf))
    return rows.select(F.col("source_id").cast("bigint").alias("recipe_id"), "ingredient_id", num("quantity"), "unit",
                       "is_required")


@register(
    "upsert_recipe_ingredients",
    f"""SELECT coalesce(t.recipe_id, s.recipe_id) AS recipe_id, coalesce(t.ingredient_id, s.ingredient_id) AS ingredient_id,
  coalesce(s.quantity, CAST(t.quantity AS DOUBLE)) AS quantity, coalesce(s.unit, t.unit) AS unit,
  coalesce(s.is_required, t.is_required) AS is_required, t.purpose,
  CASE WHEN t.recipe_id IS NULL THEN 'inserted' WHEN s.recipe_id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM recipe_ingredient t FULL JOIN (SELECT d.* FROM ({DEDUPED_LINES}) d JOIN recipe USING (recipe_id)) s
  ON t.recipe_id = s.recipe_id AND t.ingredient_id = s.ingredient_id""",
)
def upsert_recipe_ingredients(spark, sf):
    catalog = bind(spark, sf)
    recipe = catalog.recipe.select(
        F.lit("web").alias("source_type"), F.col("recipe_id").cast("string").alias("source_recipe_id"), "recipe_id"
    )
    merged = loading.upsert_recipe_ingredients(
        catalog.recipe_ingredient, _staged_lines(spark, sf), _matches(spark, sf), recipe
    )
    return merged.withColumn("quantity", num("quantity"))


@register(
    "replace_steps",
    """WITH staged AS (SELECT DISTINCT l_orderkey AS recipe_id, l_linenumber AS step_no, 'redo ' || l_linenumber AS instruction
  FROM lineitem WHERE l_tax < 0.03),
last AS (SELECT o_orderkey AS recipe_id, coalesce(max(step_no), 0) AS m FROM orders LEFT JOIN staged ON recipe_id = o_orderkey
  WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1),
kept AS (SELECT s.* FROM recipe_step s LEFT JOIN last USING (recipe_id) WHERE m IS NULL OR step_no <= m),
src AS (SELECT staged.* FROM staged JOIN last USING (recipe_id))
SELECT coalesce(k.recipe_id, s.recipe_id) AS recipe_id, coalesce(k.step_no, s.step_no) AS step_no,
  coalesce(s.instruction, k.instruction) AS instruction,
  CASE WHEN k.recipe_id IS NULL THEN 'inserted' WHEN s.recipe_id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM kept k FULL JOIN src s ON k.recipe_id = s.recipe_id AND k.step_no = s.step_no""",
)
def replace_steps(spark, sf):
    incoming = view(spark, sf, "SELECT o_orderkey AS recipe_id FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ'1997-01-01'")
    staged = view(spark, sf, """SELECT DISTINCT l_orderkey AS recipe_id, l_linenumber AS step_no,
        concat('redo ', l_linenumber) AS instruction, CAST(NULL AS STRING) AS image_url FROM {lineitem} WHERE l_tax < 0.03""")
    staged = staged.join(incoming, "recipe_id", "left_semi")
    merged = loading.replace_steps(bind(spark, sf).recipe_step, incoming, staged)
    return merged.drop("image_url")


# ---------------------------------------------------------------- categories and products

# brand > type > name paths of the parts, three levels
CATEGORY_PATHS = """SELECT DISTINCT path, parent_path, 'PRODUCT' AS category_type, name, depth FROM (
  SELECT p_brand AS path, '' AS parent_path, p_brand AS name, 0 AS depth FROM {part}
  UNION ALL SELECT concat(p_brand, ' > ', p_type), p_brand, p_type, 1 FROM {part}
  UNION ALL SELECT concat(p_brand, ' > ', p_type, ' > ', p_name), concat(p_brand, ' > ', p_type), p_name, 2 FROM {part})"""
KNOWN_CATEGORIES = """SELECT CAST(substring(p_brand, 7) AS BIGINT) AS category_id, 'PRODUCT' AS category_type,
  CAST(NULL AS BIGINT) AS parent_id, p_brand AS name, 0 AS depth, p_brand AS path
FROM (SELECT DISTINCT p_brand FROM {part} WHERE p_size > 48)"""
CATEGORY_SQL = """WITH staged AS (SELECT DISTINCT * FROM (
  SELECT p_brand AS path, '' AS parent_path, p_brand AS name, 0 AS depth FROM part
  UNION ALL SELECT p_brand || ' > ' || p_type, p_brand, p_type, 1 FROM part
  UNION ALL SELECT p_brand || ' > ' || p_type || ' > ' || p_name, p_brand || ' > ' || p_type, p_name, 2 FROM part)),
known AS (SELECT CAST(substring(p_brand, 7) AS BIGINT) AS category_id, p_brand AS path, p_brand AS name, 0 AS depth
  FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 48)),
added AS (SELECT (SELECT coalesce(max(category_id), 0) FROM known) + row_number() OVER (ORDER BY depth, path) AS category_id,
  path, parent_path, name, depth FROM staged WHERE path NOT IN (SELECT path FROM known)),
everything AS (SELECT category_id, path FROM known UNION ALL SELECT category_id, path FROM added)
"""


@register(
    "insert_categories",
    CATEGORY_SQL + """SELECT category_id, CAST(NULL AS BIGINT) AS parent_id, name, depth, path FROM known
UNION ALL SELECT a.category_id, e.category_id, a.name, a.depth, a.path FROM added a LEFT JOIN everything e ON e.path = a.parent_path""",
)
def insert_categories(spark, sf):
    rows = loading.insert_categories(view(spark, sf, KNOWN_CATEGORIES), view(spark, sf, CATEGORY_PATHS))
    return rows.drop("category_type")


TARGET_PRODUCT = """SELECT p_partkey AS product_id, 'shop' AS source_type, CAST(p_partkey AS STRING) AS source_product_id,
  concat('SKU', p_partkey) AS sku, p_name AS name, CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_type AS product_type,
  p_brand AS brand_name, CASE WHEN p_size > 10 THEN p_size END AS stock_quantity, '{{"a":"1","b":"2"}}' AS metadata
FROM {part} WHERE p_size <= 35"""
STAGED_PRODUCT = """SELECT 'shop' AS source_type, CAST(p_partkey AS STRING) AS source_product_id, concat(' NEW', p_partkey, ' ') AS sku,
  upper(p_name) AS name, CAST(p_retailprice + 1 AS DECIMAL(12,2)) AS price, 'MEAL' AS product_type,
  CASE WHEN p_size % 2 = 0 THEN concat(p_brand, ' new') ELSE ' ' END AS brand_name, CAST(NULL AS STRING) AS storage_type,
  CAST(NULL AS STRING) AS origin_country, CAST(NULL AS DECIMAL(12,2)) AS weight_g, CAST(NULL AS INT) AS unit_count,
  CASE WHEN p_size % 3 = 0 THEN 7 END AS stock_quantity, concat('{{"b":"', p_size, '"}}') AS metadata,
  concat(p_brand, ' > ', p_type) AS category_path
FROM {part} WHERE p_size >= 20"""


@register(
    "upsert_products",
    """SELECT coalesce(t.id, s.id) AS source_product_id, CASE WHEN t.id IS NULL THEN 'NEW' || s.id ELSE 'SKU' || t.id END AS sku,
  coalesce(s.name, t.name) AS name, coalesce(s.price, t.price) AS price, coalesce(s.ptype, t.ptype) AS product_type,
  coalesce(s.brand, t.brand) AS brand_name, coalesce(s.stock, t.stock) AS stock_quantity,
  CASE WHEN s.id IS NULL THEN '1/2' WHEN t.id IS NULL THEN '/' || s.size ELSE '1/' || s.size END AS metadata,
  CASE WHEN t.id IS NULL THEN 'inserted' WHEN s.id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
        p_type AS ptype, p_brand AS brand, CASE WHEN p_size > 10 THEN p_size END AS stock FROM part WHERE p_size <= 35) t
FULL JOIN (SELECT CAST(p_partkey AS VARCHAR) AS id, upper(p_name) AS name,
        CAST(CAST(p_retailprice + 1 AS DECIMAL(12,2)) AS DOUBLE) AS price, 'MEAL' AS ptype,
        CASE WHEN p_size % 2 = 0 THEN p_brand || ' new' END AS brand, CASE WHEN p_size % 3 = 0 THEN 7 END AS stock,
        p_size AS size FROM part WHERE p_size >= 20) s USING (id)""",
)
def upsert_products(spark, sf):
    category = view(spark, sf, "SELECT DISTINCT concat(p_brand, ' > ', p_type) AS path, 1L AS category_id FROM {part}")
    merged = loading.upsert_products(view(spark, sf, TARGET_PRODUCT), view(spark, sf, STAGED_PRODUCT), category)
    meta = F.concat(
        F.coalesce(F.get_json_object("metadata", "$.a"), F.lit("")), F.lit("/"), F.get_json_object("metadata", "$.b")
    )
    return merged.select("source_product_id", "sku", "name", num("price"), "product_type", "brand_name",
                         "stock_quantity", meta.alias("metadata"), "action")


STAGED_LINKS = """SELECT 'shop' AS source_type, CAST(l_partkey AS STRING) AS source_product_id, concat('n', l_suppkey % 40) AS normalized_name,
  CASE WHEN l_linenumber = 1 THEN CAST(l_suppkey % 40 AS BIGINT) END AS ingredient_id,
  CASE WHEN l_returnflag = 'A' THEN 'PRIMARY' ELSE 'SECONDARY' END AS role,
  CASE WHEN l_discount > 0.02 THEN CAST(l_quantity AS DECIMAL(12,2)) END AS quantity_g, CAST(l_extendedprice AS DECIMAL(12,5)) AS ratio
FROM {lineitem}"""


@register(
    "one_link_per_ingredient",
    """SELECT l_partkey AS product_id, l_suppkey % 40 AS ingredient_id,
  CASE WHEN l_discount > 0.02 THEN l_quantity END AS quantity_g,
  CASE WHEN l_returnflag = 'A' THEN 'PRIMARY' ELSE 'SECONDARY' END AS role, l_extendedprice AS ratio
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey % 40 ORDER BY l_returnflag = 'A' DESC,
   CASE WHEN l_discount > 0.02 THEN l_quantity END DESC NULLS LAST, l_extendedprice DESC) = 1""",
)
def one_link_per_ingredient(spark, sf):
    matches = view(spark, sf, "SELECT DISTINCT concat('n', l_suppkey % 40) AS normalized_name, CAST(l_suppkey % 40 AS BIGINT) AS ingredient_id FROM {lineitem}")
    product = view(spark, sf, "SELECT 'shop' AS source_type, CAST(p_partkey AS STRING) AS source_product_id, p_partkey AS product_id FROM {part}")
    rows = loading.one_link_per_ingredient(view(spark, sf, STAGED_LINKS), matches, product)
    return rows.select("product_id", "ingredient_id", num("quantity_g"), "role", num("ratio"))


@register(
    "upsert_product_ingredients",
    """WITH staged AS (SELECT l_partkey AS product_id, l_suppkey % 40 AS ingredient_id,
  CASE WHEN l_returnflag = 'A' THEN 'PRIMARY' ELSE 'SECONDARY' END AS role
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey % 40 ORDER BY l_returnflag = 'A' DESC,
   CASE WHEN l_discount > 0.02 THEN l_quantity END DESC NULLS LAST, l_extendedprice DESC) = 1)
SELECT coalesce(t.product_id, s.product_id) AS product_id, coalesce(t.ingredient_id, s.ingredient_id) AS ingredient_id,
  coalesce(s.role, t.role) AS role,
  CASE WHEN t.product_id IS NULL THEN 'inserted' WHEN s.product_id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM product_ingredient t FULL JOIN staged s ON t.product_id = s.product_id AND t.ingredient_id = s.ingredient_id""",
)
def upsert_product_ingredients(spark, sf):
    matches = view(spark, sf, "SELECT DISTINCT concat('n', l_suppkey % 40) AS normalized_name, CAST(l_suppkey % 40 AS BIGINT) AS ingredient_id FROM {lineitem}")
    product = view(spark, sf, "SELECT 'shop' AS source_type, CAST(p_partkey AS STRING) AS source_product_id, p_partkey AS product_id FROM {part}")
    target = bind(spark, sf).product_ingredient.selectExpr(
        "*", "CAST(NULL AS DECIMAL(12,2)) AS quantity_g", "CAST(NULL AS DECIMAL(12,5)) AS ratio"
    )
    merged = loading.upsert_product_ingredients(target, view(spark, sf, STAGED_LINKS), matches, product)
    return merged.select("product_id", "ingredient_id", "role", "action")


# ---------------------------------------------------------------- ingredient master


@register(
    "upsert_ingredient_master",
    """WITH staged AS (SELECT 'K:' || (p_partkey // 4) AS key, max(p_name) AS name, min(p_size) > 30 AS is_pantry,
   array_to_string(list_sort(list_distinct(list(p_brand))), '|') AS aliases, list(p_brand) AS brands FROM part GROUP BY p_partkey // 4)
SELECT coalesce(i.source_identity_key, s.key) AS source_identity_key, coalesce(i.name, s.name) AS name,
  coalesce(s.is_pantry, i.is_pantry) AS is_pantry,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN i.alias IS NULL THEN [] ELSE [i.alias] END, coalesce(s.brands, [])))), '|') AS aliases,
  CASE WHEN i.source_identity_key IS NULL THEN 'inserted' WHEN s.key IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM ingredient i FULL JOIN staged s ON s.key = i.source_identity_key""",
)
def upsert_ingredient_master(spark, sf):
    staged = view(spark, sf, """SELECT concat('K:', CAST(floor(p_partkey / 4) AS BIGINT)) AS source_identity_key, max(p_name) AS name,
        max(p_name) AS normalized_name, true AS is_raw_material, array_sort(collect_set(p_brand)) AS aliases,
        min(p_size) > 30 AS is_pantry, CAST(NULL AS STRING) AS category_path FROM {part} GROUP BY floor(p_partkey / 4)""")
    category = bind(spark, sf).category.selectExpr("'INGREDIENT' AS category_type", "name AS path", "category_id")
    merged = loading.upsert_ingredient_master(bind(spark, sf).ingredient, staged, category)
    return merged.select("source_identity_key", "name", "is_pantry", joined("aliases"), "action")


@register(
    "write_back_vectors",
    """SELECT p_partkey AS product_id, CASE WHEN e.vec_id IS NOT NULL THEN e.embedding[1] ELSE 9.0 END::DOUBLE AS first_value,
  coalesce(len(e.embedding), 1) AS dimensions FROM part LEFT JOIN embeddings e ON e.vec_id = p_partkey""",
)
def write_back_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.lit("product").alias("target_table"), F.concat(F.lit("shop:"), "vec_id").alias("target_key"), "embedding"
    )
    product = table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.array(F.lit(9.0).cast("float")).alias("embedding")
    )
    rows = loading.write_back_vectors(product, vectors, "product", F.concat(F.lit("shop:"), F.col("product_id")))
    return rows.select("product_id", F.col("embedding")[0].cast("double").alias("first_value"),
                       F.size("embedding").cast("bigint").alias("dimensions"))


ACTIONS = """SELECT concat('K:', CAST(floor(p_partkey / 2) AS BIGINT)) AS source_identity_key,
  CASE WHEN floor(p_partkey / 2) * 3 < (SELECT count(*) FROM {part}) THEN 'RENAME' ELSE 'INSERT' END AS action,
  concat('aligned ', max(p_name)) AS name, true AS is_raw_material, concat(min(p_brand), '||', max(p_brand)) AS aliases,
  CASE WHEN floor(p_partkey / 2) * 3 < (SELECT count(*) FROM {part}) THEN ''
       ELSE concat('K:', 1000000 + CAST(floor(p_partkey / 60) AS BIGINT)) END AS parent_source_identity_key
FROM {part} GROUP BY floor(p_partkey / 2), floor(p_partkey / 60)"""
ACTION_SQL = """WITH actions AS (SELECT 'K:' || (p_partkey // 2) AS key, (p_partkey // 2) * 3 < (SELECT count(*) FROM part) AS rename,
  'aligned ' || max(p_name) AS name, min(p_brand) AS a1, max(p_brand) AS a2, 1000000 + p_partkey // 60 AS parent
  FROM part GROUP BY p_partkey // 2, p_partkey // 60)
"""


@register(
    "alignment_plan",
    ACTION_SQL + """SELECT a.key AS source_identity_key, CASE WHEN rename THEN 'RENAME' ELSE 'INSERT' END AS action, a.name,
  CASE WHEN NOT rename AND i.ingredient_id IS NULL AND p.ingredient_id IS NULL THEN 'parent missing'
       WHEN rename AND i.ingredient_id IS NULL THEN 'nothing to rename' END AS problem
FROM actions a LEFT JOIN ingredient i ON i.source_identity_key = a.key
LEFT JOIN ingredient p ON p.ingredient_id = a.parent
WHERE (NOT rename AND i.ingredient_id IS NULL) OR rename AND (i.name IS NULL OR i.name <> a.name)""",
)
def alignment_plan(spark, sf):
    rows = loading.alignment_plan(view(spark, sf, ACTIONS), bind(spark, sf).ingredient)
    return rows.select("source_identity_key", "action", "name", "problem")


@register(
    "align_master",
    ACTION_SQL + """SELECT coalesce(i.source_identity_key, a.key) AS source_identity_key, coalesce(a.name, i.name) AS name,
  coalesce(i.parent_ingredient_id, CASE WHEN i.ingredient_id IS NULL THEN a.parent END) AS parent_ingredient_id,
  CASE WHEN i.ingredient_id IS NULL THEN 'inserted' WHEN a.key IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM ingredient i FULL JOIN (SELECT * FROM actions a WHERE rename OR 'K:' || 1 IS NOT NULL
     AND key NOT IN (SELECT source_identity_key FROM ingredient)) a ON a.key = i.source_identity_key""",
)
def align_master(spark, sf):
    ingredient = bind(spark, sf).ingredient
    plan = loading.alignment_plan(view(spark, sf, ACTIONS), ingredient)
    return loading.align_master(ingredient, plan).select(
        "source_identity_key", "name", "parent_ingredient_id", "action"
    )


@register(
    "parts_plan",
    """SELECT 'K:' || (p_partkey // 2) AS source_identity_key, CASE WHEN p.ingredient_id IS NULL THEN 'orphan'
   WHEN i.ingredient_id IS NOT NULL THEN 'exists' ELSE 'new' END AS outcome
FROM (SELECT DISTINCT p_partkey // 2 * 2 AS p_partkey FROM part) x
LEFT JOIN ingredient i ON i.source_identity_key = 'K:' || (p_partkey // 2)
LEFT JOIN ingredient p ON p.source_identity_key = 'K:' || (1000000 + p_partkey // 20)""",
)
def parts_plan(spark, sf):
    parts = view(spark, sf, """SELECT DISTINCT concat('K:', CAST(floor(p_partkey / 2) AS BIGINT)) AS source_identity_key,
        concat('K:', 1000000 + CAST(floor(floor(p_partkey / 2) * 2 / 20) AS BIGINT)) AS parent_key FROM {part}""")
    return loading.parts_plan(parts, bind(spark, sf).ingredient).select("source_identity_key", "outcome")


REVIEWED = """SELECT DISTINCT concat('K:', CAST(floor(p_partkey / 3) AS BIGINT)) AS source_identity_key, concat(p_type, ' ', CAST(floor(p_partkey / 3) AS BIGINT)) AS alias
FROM {part} WHERE p_size <= 25"""


@register(
    "alias_changes",
    """WITH reviewed AS (SELECT 'K:' || (p_partkey // 3) AS key, list_sort(list_distinct(list(p_type || ' ' || (p_partkey // 3)))) AS keep
  FROM part WHERE p_size <= 25 GROUP BY 1)
SELECT i.ingredient_id, array_to_string(coalesce(keep, []), '|') AS keep,
  CASE WHEN alias IS NOT NULL AND NOT list_contains(coalesce(keep, []), alias) THEN alias ELSE '' END AS removed
FROM ingredient i LEFT JOIN reviewed r ON r.key = i.source_identity_key
WHERE CASE WHEN alias IS NULL THEN [] ELSE [alias] END <> coalesce(keep, [])""",
)
def alias_changes(spark, sf):
    rows = loading.alias_changes(bind(spark, sf).ingredient, view(spark, sf, REVIEWED))
    return rows.select("ingredient_id", joined("keep"), joined("removed"))


@register(
    "reset_aliases",
    """SELECT i.ingredient_id, coalesce(array_to_string(list_sort(r.keep), '|'), '') AS aliases FROM ingredient i
LEFT JOIN (SELECT p_partkey // 3 AS id, list_distinct(list(p_type || ' ' || (p_partkey // 3))) AS keep FROM part
           WHERE p_size <= 25 GROUP BY 1) r ON r.id = i.ingredient_id""",
)
def reset_aliases(spark, sf):
    rows = loading.reset_aliases(bind(spark, sf).ingredient, view(spark, sf, REVIEWED))
    return rows.select("ingredient_id", joined("aliases"))


@register(
    "removed_alias_top",
    """SELECT name, 1::BIGINT AS removed_count FROM ingredient i WHERE alias IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM part WHERE p_size <= 25 AND p_partkey // 3 = i.ingredient_id AND p_type || ' ' || (p_partkey // 3) = i.alias)
ORDER BY name LIMIT 8""",
)
def removed_alias_top(spark, sf):
    changes = loading.alias_changes(bind(spark, sf).ingredient, view(spark, sf, REVIEWED))
    removed = changes.filter(F.size("removed") > 0).select("name", F.explode("removed").alias("alias"))
    counts = removed.groupBy("name").agg(F.count("*").alias("removed_count"))
    return counts.orderBy(F.col("removed_count").desc(), "name").limit(8)


@register(
    "children_per_parent",
    """SELECT p.ingredient_id, p.name, string_agg(c.name, ', ' ORDER BY c.name) AS children
FROM ingredient c JOIN ingredient p ON p.ingredient_id = c.parent_ingredient_id GROUP BY 1, 2""",
)
def children_per_parent(spark, sf):
    ingredient = bind(spark, sf).ingredient
    parents = ingredient.select(F.col("ingredient_id").alias("parent_ingredient_id"), F.col("name").alias("parent_name"))
    return (
        ingredient.join(parents, "parent_ingredient_id")
        .groupBy(F.col("parent_ingredient_id").alias("ingredient_id"), F.col("parent_name").alias("name"))
        .agg(F.expr("listagg(name, ', ') WITHIN GROUP (ORDER BY name)").alias("children"))
    )


@register(
    "master_report",
    """SELECT count(*) FILTER (WHERE is_raw_material) AS raw, count(*) FILTER (WHERE NOT is_raw_material) AS processed,
  count(alias) AS with_alias, count(alias) AS alias_total, count(*) FILTER (WHERE is_pantry) AS pantry FROM ingredient""",
)
def master_report(spark, sf):
    from mealgrid.plans.reports import master_report as report

    return report(bind(spark, sf).ingredient)


# ---------------------------------------------------------------- guideline, stock, availability


@register(
    "load_guideline",
    """WITH old AS (SELECT * FROM storage_guideline WHERE duration_min > 1),
processed AS (SELECT DISTINCT source_food_name, coalesce(source_food_subtitle, '') AS sub FROM storage_staging WHERE duration_unit = '시간' AND duration_min >= 5),
pruned AS (SELECT o.* FROM old o SEMI JOIN (SELECT ingredient_id FROM ingredient WHERE is_raw_material) r USING (ingredient_id)
   WHERE (o.source_food_name, coalesce(o.source_food_subtitle, '')) IN (SELECT (source_food_name, sub) FROM processed)),
lef AS (SELECT o.* FROM old o ANTI JOIN pruned p USING (ingredient_id, storage_location, storage_context)),
acc AS (SELECT * FROM storage_guideline WHERE duration_unit <> '개월')
SELECT ingredient_id, storage_location, storage_context,
  CASE WHEN a.storage_id IS NOT NULL THEN a.duration_text || '!' ELSE l.duration_text END AS duration_text,
  CASE WHEN l.storage_id IS NULL THEN 'inserted' WHEN a.storage_id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM lef l FULL JOIN acc a USING (ingredient_id, storage_location, storage_context)
UNION ALL SELECT ingredient_id, storage_location, storage_context, duration_text, 'pruned' FROM pruned""",
)
def load_guideline(spark, sf):
    guideline = bind(spark, sf).storage_guideline
    old = guideline.filter(F.col("duration_min") > 1)
    accepted = guideline.filter(F.col("duration_unit") != "개월").withColumn(
        "duration_text", F.concat("duration_text", F.lit("!"))
    )
    processed = storage_staging(spark, sf).filter("duration_unit = '시간' AND duration_min >= 5").select(
        "source_food_name", "source_food_subtitle"
    )
    raw = bind(spark, sf).ingredient.filter("is_raw_material")
    rows = loading.load_guideline(old, accepted, processed, raw)
    return rows.select("ingredient_id", "storage_location", "storage_context", "duration_text", "action")


@register(
    "guarded_stock_update",
    """SELECT p_partkey AS product_id,
  CASE WHEN (p_size % 7 = 0 OR p_size % 3 = 0) AND sold IS NOT NULL THEN sold ELSE CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END END AS stock_quantity,
  CASE WHEN (p_size % 7 = 0 OR p_size % 3 = 0) AND sold IS NOT NULL THEN 'seed' WHEN p_size % 3 = 0 THEN 'seed' ELSE 'crawl' END AS stock_source,
  CASE WHEN (p_size % 7 = 0 OR p_size % 3 = 0) AND sold IS NOT NULL THEN 'updated' ELSE 'kept' END AS action
FROM part LEFT JOIN (SELECT l_partkey, CAST(count(*) AS INTEGER) AS sold FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey""",
)
def guarded_stock_update(spark, sf):
    product = view(spark, sf, """SELECT p_partkey AS product_id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS stock_quantity,
        CASE WHEN p_size % 3 = 0 THEN '{{"stock_source":"seed"}}' ELSE '{{"stock_source":"crawl"}}' END AS metadata FROM {part}""")
    stock = view(spark, sf, "SELECT l_partkey AS product_id, CAST(count(*) AS INT) AS stock_quantity FROM {lineitem} WHERE l_quantity > 45 GROUP BY l_partkey")
    rows = loading.guarded_stock_update(product, stock, "seed")
    return rows.select("product_id", "stock_quantity", F.get_json_object("metadata", "$.stock_source").alias("stock_source"), "action")


@register(
    "make_available",
    """SELECT product_id, is_active OR coalesce(f, false) AS is_active,
  CASE WHEN f AND stock_quantity = 0 THEN NULL ELSE stock_quantity END AS stock_quantity, coalesce(f, false) AS changed
FROM (SELECT p.*, c.product_id IS NOT NULL AND (NOT p.is_active OR coalesce(p.stock_quantity = 0, false)) AS f
      FROM product p LEFT JOIN (SELECT DISTINCT product_id FROM user_fridge) c USING (product_id))""",
)
def make_available(spark, sf):
    catalog = bind(spark, sf)
    rows = loading.make_available(catalog.product, catalog.user_fridge)
    return rows.select("product_id", "is_active", "stock_quantity", "changed")


@register(
    "link_parents",
    """SELECT i.ingredient_id, CASE WHEN w.wanted IS NULL THEN 'parent missing' WHEN i.parent_ingredient_id = w.wanted THEN 'already'
    WHEN i.parent_ingredient_id IS NOT NULL THEN 'conflict' ELSE 'linked' END AS outcome
FROM ingredient i LEFT JOIN (SELECT name, min(ingredient_id) AS wanted FROM ingredient GROUP BY 1) w
  ON w.name = 'Brand#1 ' || (1000000 + i.ingredient_id // 10)""",
)
def link_parents(spark, sf):
    ingredient = bind(spark, sf).ingredient
    wanted = ingredient.selectExpr(
        "ingredient_id", "concat('Brand#1 ', 1000000 + CAST(floor(ingredient_id / 10) AS BIGINT)) AS parent_name"
    )
    return loading.link_parents(ingredient, wanted).select("ingredient_id", "outcome")


# ---------------------------------------------------------------- fridge and activity

DELIVERED = """SELECT o_custkey AS user_id, l_partkey + CASE WHEN l_tax > 0.07 THEN 100000000 ELSE 0 END AS product_id,
  CAST(l_quantity AS DECIMAL(12,3)) AS quantity, l_linestatus AS unit, l_shipdate AS expires_at, l_discount > 0.05 AS set_expiry,
  struct(l_shipdate, l_extendedprice) AS item_no
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP_NTZ'1997-12-15' AND l_shipdate < TIMESTAMP_NTZ'1998-02-01'"""
DELIVERED_SQL = f"""WITH items AS (SELECT o_custkey AS user_id, l_partkey + CASE WHEN l_tax > 0.07 THEN 100000000 ELSE 0 END AS product_id,
  sum(l_quantity) AS quantity, arg_max(l_linestatus, (l_shipdate, l_extendedprice)) AS unit,
  arg_max(l_shipdate, (l_shipdate, l_extendedprice)) AS expires_at, arg_max(l_discount > 0.05, (l_shipdate, l_extendedprice)) AS set_expiry
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE l_shipdate >= TIMESTAMP '1997-12-15' AND l_shipdate < TIMESTAMP '1998-02-01' GROUP BY 1, 2),
outcome AS (SELECT i.*, CASE WHEN p.product_id IS NULL THEN 'skipped' WHEN f.product_id IS NOT NULL THEN 'updated'
     WHEN m.product_id IS NULL THEN 'skipped' ELSE 'inserted' END AS action,
   CASE WHEN p.product_id IS NULL THEN 'PRODUCT_NOT_FOUND' WHEN f.product_id IS NULL AND m.product_id IS NULL THEN 'NO_PRIMARY_INGREDIENT' END AS reason
  FROM items i LEFT JOIN product p USING (product_id) LEFT JOIN user_fridge f ON f.user_id = i.user_id AND f.product_id = i.product_id
  LEFT JOIN (SELECT DISTINCT product_id FROM product_ingredient WHERE role = 'PRIMARY') m ON m.product_id = i.product_id)
"""


@register(
    "delivery_outcomes",
    DELIVERED_SQL + "SELECT user_id, product_id, quantity, unit, action, reason FROM outcome",
)
def delivery_outcomes(spark, sf):
    catalog = bind(spark, sf)
    rows = loading.delivery_outcomes(
        catalog.user_fridge, view(spark, sf, DELIVERED), catalog.product, catalog.product_ingredient
    )
    return rows.select("user_id", "product_id", num("quantity"), "unit", "action", "reason")


@register(
    "add_deliveries",
    DELIVERED_SQL + f"""SELECT coalesce(f.user_id, o.user_id) AS user_id, coalesce(f.product_id, o.product_id) AS product_id,
  coalesce(f.quantity, 0) + coalesce(o.quantity, 0) AS quantity, coalesce(o.unit, f.unit) AS unit,
  {stamp_sql("CASE WHEN f.user_id IS NULL THEN o.expires_at WHEN o.set_expiry THEN o.expires_at ELSE f.expires_at END", "expires_at")},
  CASE WHEN f.user_id IS NULL THEN 'inserted' WHEN o.user_id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM user_fridge f FULL JOIN (SELECT * FROM outcome WHERE action <> 'skipped') o ON f.user_id = o.user_id AND f.product_id = o.product_id""",
)
def add_deliveries(spark, sf):
    catalog = bind(spark, sf)
    rows = loading.add_deliveries(
        catalog.user_fridge, view(spark, sf, DELIVERED), catalog.product, catalog.product_ingredient
    )
    return rows.select("user_id", "product_id", num("quantity"), "unit", stamp("expires_at"), "action")


@register(
    "add_to_fridge",
    """SELECT pi.ingredient_id, c.c_custkey AS user_id, pi.product_id,
   CASE WHEN f.user_id IS NOT NULL THEN CAST(f.quantity AS DOUBLE) ELSE 1.0 END AS quantity,
   CASE WHEN f.user_id IS NOT NULL THEN 'kept' ELSE 'inserted' END AS action
FROM (SELECT c_custkey, c_custkey % (SELECT count(*) FROM part) AS pid FROM customer) c
JOIN product_ingredient pi ON pi.product_id = c.pid AND pi.role = 'PRIMARY'
LEFT JOIN user_fridge f ON f.user_id = c.c_custkey AND f.product_id = pi.product_id
UNION ALL SELECT pi.ingredient_id, f.user_id, f.product_id, CAST(f.quantity AS DOUBLE), 'kept' FROM user_fridge f
JOIN product_ingredient pi ON pi.product_id = f.product_id AND pi.role = 'PRIMARY'
WHERE f.user_id % (SELECT count(*) FROM part) <> f.product_id""",
)
def add_to_fridge(spark, sf):
    catalog = bind(spark, sf)
    links = catalog.product_ingredient.filter("role = 'PRIMARY'").select("product_id", "ingredient_id")
    fridge = catalog.user_fridge.join(links, "product_id")
    items = view(spark, sf, """SELECT c_custkey AS user_id, c_custkey % (SELECT count(*) FROM {part}) AS product_id,
        CAST(1 AS DECIMAL(12,3)) AS quantity, 'ea' AS unit, CAST(NULL AS TIMESTAMP_NTZ) AS expires_at FROM {customer}""")
    rows = loading.add_to_fridge(fridge, items, catalog.product_ingredient)
    # a slot that is added again stays untouched, whether the source names it or not
    action = F.when(F.col("action") == "inserted", "inserted").otherwise("kept")
    return rows.select("ingredient_id", "user_id", "product_id", num("quantity"), action.alias("action"))


@register(
    "patch_fridge",
    f"""SELECT f.user_id, f.product_id, coalesce(c.quantity, CAST(f.quantity AS DOUBLE)) AS quantity, f.unit,
  {stamp_sql("CASE WHEN c.set_expiry THEN c.expires_at ELSE f.expires_at END", "expires_at")}
FROM user_fridge f LEFT JOIN (SELECT user_id, product_id, CASE WHEN affinity_score > 0.1 THEN 2.0 END AS quantity,
     purchase_count = 1 AS set_expiry, CASE WHEN product_id % 2 = 0 THEN last_purchased_at END AS expires_at FROM user_product_affinity) c
  ON c.user_id = f.user_id AND c.product_id = f.product_id""",
)
def patch_fridge(spark, sf):
    catalog = bind(spark, sf)
    changes = catalog.user_product_affinity.selectExpr(
        "user_id", "product_id", "CASE WHEN affinity_score > 0.1 THEN CAST(2 AS DECIMAL(12,3)) END AS quantity",
        "CAST(NULL AS STRING) AS unit", "purchase_count = 1 AS set_expiry",
        "CASE WHEN product_id % 2 = 0 THEN last_purchased_at END AS expires_at",
    )
    rows = loading.patch_fridge(catalog.user_fridge, changes)
    return rows.select("user_id", "product_id", num("quantity"), "unit", stamp("expires_at"))


@register(
    "delete_keys",
    """SELECT v.user_id, v.recipe_id, f.user_id IS NOT NULL AS deleted FROM user_recipe_view v
LEFT JOIN user_recipe_favorite f ON f.user_id = v.user_id AND f.recipe_id = v.recipe_id""",
)
def delete_keys(spark, sf):
    catalog = bind(spark, sf)
    left, deleted = loading.delete_keys(
        catalog.user_recipe_view, catalog.user_recipe_favorite, ["user_id", "recipe_id"]
    )
    return (
        left.withColumn("deleted", F.lit(False))
        .unionByName(deleted.withColumn("deleted", F.lit(True)))
        .select("user_id", "recipe_id", "deleted")
    )


@register(
    "add_favorites",
    f"""SELECT coalesce(f.user_id, a.user_id) AS user_id, coalesce(f.recipe_id, a.recipe_id) AS recipe_id,
  {stamp_sql("coalesce(f.created_at, a.viewed_at)", "created_at")}
FROM user_recipe_favorite f FULL JOIN user_recipe_view a ON a.user_id = f.user_id AND a.recipe_id = f.recipe_id""",
)
def add_favorites(spark, sf):
    catalog = bind(spark, sf)
    added = catalog.user_recipe_view.withColumnRenamed("viewed_at", "created_at")
    return loading.add_favorites(catalog.user_recipe_favorite, added).select(
        "user_id", "recipe_id", stamp("created_at")
    )


@register(
    "record_views",
    f"""WITH m AS (SELECT coalesce(v.user_id, c.user_id) AS user_id, coalesce(v.recipe_id, c.recipe_id) AS recipe_id,
  greatest(v.viewed_at, c.created_at) AS viewed_at
FROM user_recipe_view v FULL JOIN user_recipe_favorite c ON c.user_id = v.user_id AND c.recipe_id = v.recipe_id)
SELECT user_id, recipe_id, {stamp_sql('viewed_at')} FROM m
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY viewed_at DESC, recipe_id DESC) <= 12""",
)
def record_views(spark, sf):
    catalog = bind(spark, sf)
    seen = catalog.user_recipe_favorite.withColumnRenamed("created_at", "viewed_at")
    return loading.record_views(catalog.user_recipe_view, seen, keep=12).select(
        "user_id", "recipe_id", stamp("viewed_at")
    )


@register(
    "ensure_users",
    """SELECT coalesce(c.c_custkey, e.user_id) AS user_id, CASE WHEN c.c_custkey IS NULL THEN 'inserted' WHEN e.user_id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = c.c_custkey""",
)
def ensure_users(spark, sf):
    users = view(spark, sf, "SELECT c_custkey AS user_id, CAST('2020-01-01' AS TIMESTAMP_NTZ) AS created_at FROM {customer} WHERE c_acctbal > 0")
    return loading.ensure_users(users, table(spark, sf, "events"), AS_OF).select("user_id", "action")


@register(
    "replace_user_sets",
    f"""SELECT user_id, product_id, 'old' AS origin FROM user_fridge
WHERE user_id NOT IN (SELECT user_id FROM user_product_affinity WHERE affinity_score > 0.1)
UNION ALL SELECT user_id, product_id, 'new' FROM user_product_affinity WHERE affinity_score > 0.1""",
)
def replace_user_sets(spark, sf):
    catalog = bind(spark, sf)
    old = catalog.user_fridge.select("user_id", "product_id", F.lit("old").alias("origin"))
    new = catalog.user_product_affinity.filter("affinity_score > 0.1").select(
        "user_id", "product_id", F.lit("new").alias("origin")
    )
    return loading.replace_user_sets(old, new)


@register(
    "upsert_priorities",
    """SELECT coalesce(t.recipe_id, s.recipe_id) AS recipe_id, coalesce(t.ingredient_id, s.ingredient_id) AS ingredient_id,
  coalesce(t.product_id, s.product_id) AS product_id, coalesce(s.p, t.recommendation_priority) AS recommendation_priority
FROM recipe_product t FULL JOIN (SELECT l_orderkey AS recipe_id, l_partkey // 3 AS ingredient_id, l_partkey AS product_id, 100 AS p
   FROM lineitem WHERE l_tax >= 0.08 GROUP BY 1, 2, 3) s USING (recipe_id, ingredient_id, product_id)""",
)
def upsert_priorities(spark, sf):
    wanted = view(spark, sf, """SELECT DISTINCT l_orderkey AS recipe_id, CAST(floor(l_partkey / 3) AS BIGINT) AS ingredient_id,
        l_partkey AS product_id, 100 AS recommendation_priority FROM {lineitem} WHERE l_tax >= 0.08""")
    return loading.upsert_priorities(bind(spark, sf).recipe_product, wanted).drop("action")


@register(
    "undo_restores",
    "SELECT product_id, is_active, stock_quantity FROM product",
)
def undo_restores(spark, sf):
    catalog = bind(spark, sf)
    image = loading.before_image(catalog.product, catalog.user_fridge, ["product_id"])
    changed = loading.make_available(catalog.product, catalog.user_fridge).drop("changed")
    return loading.restore(changed, image, ["product_id"]).select("product_id", "is_active", "stock_quantity")


@register(
    "before_image",
    """SELECT a.product_id, p.product_id IS NOT NULL AS existed, p.stock_quantity FROM (SELECT DISTINCT product_id + 100 AS product_id FROM user_fridge) a
LEFT JOIN product p USING (product_id)""",
)
def before_image(spark, sf):
    catalog = bind(spark, sf)
    affected = catalog.user_fridge.select((F.col("product_id") + 100).alias("product_id"))
    return loading.before_image(catalog.product, affected, ["product_id"]).select(
        "product_id", "existed", "stock_quantity"
    )


@register(
    "load_report",
    """SELECT 'recipe' AS table_name, count(*) AS row_count FROM recipe UNION ALL SELECT 'recipe_ingredient', count(*) FROM recipe_ingredient
UNION ALL SELECT 'recipe_step', count(*) FROM recipe_step UNION ALL SELECT 'storage_guideline', count(*) FROM storage_guideline
UNION ALL SELECT 'staging', 0""",
)
def load_report(spark, sf):
    catalog = bind(spark, sf)
    return loading.load_report(
        recipe=catalog.recipe,
        recipe_ingredient=catalog.recipe_ingredient,
        recipe_step=catalog.recipe_step,
        storage_guideline=catalog.storage_guideline,
        staging=loading.empty_staging(storage_staging(spark, sf)),
    )


@register(
    "timestamps_as_utc",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_seconds FROM events",
)
def timestamps_as_utc(spark, sf):
    events = loading.as_utc(table(spark, sf, "events"))
    return events.select("event_id", F.unix_seconds("ts").alias("epoch_seconds"))


@register(
    "merge_action_counts",
    """SELECT action, count(*) AS n FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'kept'
   WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'updated' ELSE 'inserted' END AS action FROM orders) GROUP BY 1""",
)
def merge_action_counts(spark, sf):
    return merge.action_counts(
        loading.upsert_recipes(view(spark, sf, TARGET_RECIPE), view(spark, sf, STAGED_RECIPE))
    )
