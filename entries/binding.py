"""The given star-schema tables seen as the recipe catalog (see FIXTURES.md, part C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.core.catalog import Catalog
from mealgrid.plans.storage import select_representatives

AS_OF = "1998-01-01 00:00:00"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read with its declared schema (no inference job); times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


_CHILD = "CAST(floor(p_partkey / 3) AS BIGINT)"
_PARENT = "1000000 + CAST(floor(p_partkey / 30) AS BIGINT)"

INGREDIENT = f"""
SELECT {_CHILD} AS ingredient_id, {_PARENT} AS parent_ingredient_id,
       {_CHILD} % 10 = 0 AS is_pantry,
       CAST(floor(p_partkey / 30) AS BIGINT) % 25 AS ingredient_category_id,
       concat(min(p_name), ' ', {_CHILD}) AS name,
       lower(replace(concat(min(p_name), ' ', {_CHILD}), ' ', '')) AS normalized_name,
       concat(min(p_type), ' ', {_CHILD}) AS alias,
       min(p_size) <= 25 AS is_raw_material,
       concat('K:', {_CHILD}) AS source_identity_key
FROM {{part}} GROUP BY floor(p_partkey / 3), floor(p_partkey / 30)
UNION ALL
SELECT {_PARENT}, CAST(NULL AS BIGINT), false,
       CAST(floor(p_partkey / 30) AS BIGINT) % 25,
       concat(min(p_brand), ' ', {_PARENT}),
       lower(replace(concat(min(p_brand), ' ', {_PARENT}), ' ', '')),
       CAST(NULL AS STRING), true, concat('K:', {_PARENT})
FROM {{part}} GROUP BY floor(p_partkey / 30)
"""

PRODUCT = """
SELECT p_partkey AS product_id, p_name AS name, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
       CASE WHEN p_size % 10 = 0 THEN 0 WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS stock_quantity,
       p_size <> 1 AS is_active,
       CASE p_size % 4 WHEN 0 THEN '냉장' WHEN 1 THEN '냉동' WHEN 2 THEN '상온' END AS storage_type,
       CAST(p_size * 10 AS DECIMAL(12,2)) AS weight_g, p_size AS unit_count, p_type AS product_type,
       p_brand AS origin_country, CAST(p_partkey % 25 AS BIGINT) AS category_id,
       concat('p/', p_partkey, '.jpg') AS image_url
FROM {part}
"""

PRODUCT_INGREDIENT = """
SELECT p_partkey AS product_id, CAST(floor(p_partkey / 3) AS BIGINT) AS ingredient_id, 'PRIMARY' AS role
FROM {part} WHERE p_partkey % 17 <> 0
UNION ALL
SELECT p_partkey, CAST(floor(p_partkey / 3) AS BIGINT) + 1, CASE WHEN p_partkey % 2 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END
FROM {part} WHERE p_partkey % 11 = 0 AND p_partkey + 3 < (SELECT count(*) FROM {part})
"""

RECIPE = """
SELECT o_orderkey AS recipe_id, concat(o_orderpriority, ' ', o_orderkey) AS name,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(5 + o_orderkey % 60 AS INT) END AS cook_time_min,
       CAST(o_custkey % 30 AS INT) AS prep_time_min,
       CAST(1 + o_orderkey % 6 AS DECIMAL(5,2)) AS servings, o_orderpriority AS difficulty,
       o_orderstatus AS cooking_method, concat('r/', o_orderkey, '.jpg') AS image_url,
       CASE WHEN o_totalprice > 250000 THEN concat('dish of ', o_custkey) END AS description,
       CAST(o_orderkey % 25 AS BIGINT) AS category_id,
       array(o_orderstatus, o_orderpriority) AS tags
FROM {orders}
"""

RECIPE_INGREDIENT = """
SELECT recipe_id, ingredient_id, bool_or(l_returnflag <> 'R') AS is_required,
       CAST(max(l_quantity) AS DECIMAL(10,3)) AS quantity, 'g' AS unit,
       CASE WHEN max(l_tax) > 0.07 THEN 'sauce' END AS purpose
FROM (SELECT l_orderkey AS recipe_id,
             CASE WHEN l_linenumber % 3 = 0 THEN 1000000 + CAST(floor(l_partkey / 30) AS BIGINT)
                  ELSE CAST(floor(l_partkey / 3) AS BIGINT) END AS ingredient_id,
             l_returnflag, l_quantity, l_tax
      FROM {lineitem})
GROUP BY recipe_id, ingredient_id
"""

RECIPE_STEP = """
SELECT DISTINCT l_orderkey AS recipe_id, l_linenumber AS step_no,
       concat('step ', l_linenumber) AS instruction, CAST(NULL AS STRING) AS image_url
FROM {lineitem} WHERE l_discount < 0.08
"""

RECIPE_PRODUCT = """
SELECT recipe_id, ingredient_id, product_id, CAST(max(priority) AS INT) AS recommendation_priority
FROM (SELECT l_orderkey AS recipe_id, l_partkey AS product_id, round(l_tax * 100) AS priority,
             CASE WHEN l_linenumber % 3 = 0 THEN 1000000 + CAST(floor(l_partkey / 30) AS BIGINT)
                  ELSE CAST(floor(l_partkey / 3) AS BIGINT) END AS ingredient_id
      FROM {lineitem} WHERE l_discount >= 0.09)
GROUP BY recipe_id, ingredient_id, product_id
"""

USER_FRIDGE = """
SELECT o_custkey AS user_id, l_partkey AS product_id, CAST(sum(l_quantity) AS DECIMAL(12,3)) AS quantity, 'ea' AS unit,
       CASE WHEN max(l_linenumber) <> 7 THEN max(l_shipdate + make_dt_interval(CAST(l_quantity AS INT))) END AS expires_at
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE l_shipdate >= TIMESTAMP_NTZ'1997-11-01' AND l_shipdate < TIMESTAMP_NTZ'1998-01-01'
GROUP BY o_custkey, l_partkey
"""

USER_PRODUCT_AFFINITY = """
SELECT o_custkey AS user_id, l_partkey AS product_id, count(*) AS purchase_count,
       max(o_orderdate) AS last_purchased_at, least(1.0D, count(*) / 12.0D) AS affinity_score
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderdate < TIMESTAMP_NTZ'1998-01-01'
GROUP BY o_custkey, l_partkey
"""

PRODUCT_POPULARITY = """
SELECT l_partkey AS product_id, CAST(add_months(trunc(CAST(l_shipdate AS DATE), 'QUARTER'), 3) AS DATE) AS period_end,
       count(*) AS order_count, sum(l_quantity) AS popularity_score
FROM {lineitem} GROUP BY l_partkey, trunc(CAST(l_shipdate AS DATE), 'QUARTER')
"""

STORAGE_STAGING = """
SELECT ingredient_id, storage_location, storage_context, source_item_id,
       concat('food ', source_item_id % 7) AS source_food_name,
       CASE WHEN source_item_id % 3 = 0 THEN concat('kind ', source_item_id % 5) END AS source_food_subtitle,
       concat('slot', lpad(CAST(source_item_id AS STRING), 14, '0')) AS source_slot,
       CAST(lo AS INT) AS duration_min, CAST(hi + 1 AS INT) AS duration_max,
       CASE line % 4 WHEN 0 THEN '시간' WHEN 1 THEN '일' WHEN 2 THEN '주' ELSE '개월' END AS duration_unit,
       concat(CAST(lo AS INT), '-', CAST(hi + 1 AS INT)) AS duration_text,
       CASE WHEN discount > 0.05 THEN concat('tip ', source_item_id % 100) END AS storage_tips
FROM (SELECT CAST(floor(l_partkey / 3) AS BIGINT) AS ingredient_id,
             CASE l_returnflag WHEN 'A' THEN '냉장' WHEN 'N' THEN '상온' ELSE '냉동' END AS storage_location,
             CASE l_linestatus WHEN 'O' THEN '일반' ELSE '개봉후' END AS storage_context,
             l_orderkey * 100000 + l_partkey AS source_item_id, min(l_quantity) AS lo, max(l_quantity) AS hi,
             min(l_linenumber) AS line, max(l_discount) AS discount
      FROM {lineitem} WHERE l_quantity <= 5
      GROUP BY floor(l_partkey / 3), l_returnflag, l_linestatus, l_orderkey * 100000 + l_partkey)
"""

BUBBLE_KEYWORD = """
SELECT * FROM VALUES
 ('LOW_INGREDIENT', 'few ingredients', 'at most three', 'ingredient_count', '{"op": "lte", "value": 3}', 10, 1, true),
 ('FEW_STEPS', 'few steps', 'at most two steps', 'step_count', '{"op": "lte", "value": 2}', 10, 2, true),
 ('LIGHT', 'light', 'mostly light', 'ingredient_category',
  '{"op": "ratio_gte", "value": 0.6, "category_names": ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5", "NATION_6", "NATION_7"]}', 10, 3, true),
 ('MEAT', 'meat', 'with meat', 'ingredient_category', '{"op": "contains", "category_names": ["NATION_3"]}', 10, 4, true),
 ('QUICK_15MIN', 'quick', 'in 15 minutes', 'cook_time', '{"op": "lte", "value": 15}', 10, 5, true),
 ('FOR_TWO', 'for two', 'two servings', 'servings', '{"op": "lte", "value": 2}', 100000, 6, true),
 ('UNKNOWN_RULE', 'unknown', 'no rule', 'weather', '{"op": "lte", "value": 2}', 10, 7, true),
 ('RETIRED', 'retired', 'not active', 'cook_time', '{"op": "lte", "value": 99}', 10, 8, false)
AS t(keyword_id, label, description, rule_type, rule_spec, min_candidates, display_order, is_active)
"""

CATEGORY = """
SELECT CAST(n_nationkey AS BIGINT) AS category_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS parent_id FROM {nation}
"""

USER_RECIPE_VIEW = """
SELECT user_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS recipe_id, max(ts) AS viewed_at
FROM {events} WHERE event_type = 'view' GROUP BY user_id, get_json_object(props, '$.k')
"""

USER_RECIPE_FAVORITE = """
SELECT user_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS recipe_id, min(ts) AS created_at
FROM {events} WHERE event_type = 'click' GROUP BY user_id, get_json_object(props, '$.k')
"""

# one request per viewed recipe: the chosen product comes from the event value
REQUESTS = """
SELECT DISTINCT user_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS recipe_id,
       CASE WHEN value < 100 THEN CAST(floor(value * 10) AS BIGINT) END AS base_product_id
FROM {events} WHERE event_type = 'view'
"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A bound table from its definition."""
    needed = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in text}
    return spark.sql(text, **needed) if needed else spark.sql(text)


def storage_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed storage guidance before one row per key is chosen."""
    return view(spark, sf_dir, STORAGE_STAGING)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, recipe_id, base_product_id) requests."""
    return view(spark, sf_dir, REQUESTS)


class BoundCatalog:
    """The catalog over the given tables; a table is only built when a query asks for it."""

    _SOURCES = {
        "product": PRODUCT,
        "product_ingredient": PRODUCT_INGREDIENT,
        "recipe": RECIPE,
        "recipe_ingredient": RECIPE_INGREDIENT,
        "recipe_step": RECIPE_STEP,
        "recipe_product": RECIPE_PRODUCT,
        "user_fridge": USER_FRIDGE,
        "user_product_affinity": USER_PRODUCT_AFFINITY,
        "product_popularity": PRODUCT_POPULARITY,
        "bubble_keyword": BUBBLE_KEYWORD,
        "user_recipe_favorite": USER_RECIPE_FAVORITE,
        "user_recipe_view": USER_RECIPE_VIEW,
        "category": CATEGORY,
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._spark, self._sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "ingredient":
            built = view(self._spark, self._sf_dir, INGREDIENT)
            built = built.withColumn("aliases", F.array_compact(F.array("alias"))).drop("alias")
        elif name == "storage_guideline":
            staged = storage_staging(self._spark, self._sf_dir)
            built = select_representatives(staged).withColumnRenamed("source_item_id", "storage_id")
        elif name in self._SOURCES:
            built = view(self._spark, self._sf_dir, self._SOURCES[name])
        else:
            raise AttributeError(name)
        setattr(self, name, built)
        return built


def bind(spark: SparkSession, sf_dir: str) -> Catalog:
    """The whole catalog over the given tables."""
    return BoundCatalog(spark, sf_dir)
