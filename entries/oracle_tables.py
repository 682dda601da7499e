"""DuckDB definitions of the bound tables, as common table expressions for the oracles."""

from __future__ import annotations

_LINE_INGREDIENT = ("CASE WHEN l_linenumber % 3 = 0 THEN 1000000 + l_partkey // 30 ELSE l_partkey // 3 END")
AS_OF = "TIMESTAMP '1998-01-01 00:00:00'"

CTES = {
    "ingredient": """
SELECT p_partkey // 3 AS ingredient_id, 1000000 + p_partkey // 30 AS parent_ingredient_id,
       (p_partkey // 3) % 10 = 0 AS is_pantry, (p_partkey // 30) % 25 AS ingredient_category_id,
       min(p_name) || ' ' || (p_partkey // 3) AS name,
       lower(replace(min(p_name) || ' ' || (p_partkey // 3), ' ', '')) AS normalized_name,
       min(p_type) || ' ' || (p_partkey // 3) AS alias, min(p_size) <= 25 AS is_raw_material,
       'K:' || (p_partkey // 3) AS source_identity_key
FROM part GROUP BY p_partkey // 3, p_partkey // 30
UNION ALL
SELECT 1000000 + p_partkey // 30, NULL, false, (p_partkey // 30) % 25,
       min(p_brand) || ' ' || (1000000 + p_partkey // 30),
       lower(replace(min(p_brand) || ' ' || (1000000 + p_partkey // 30), ' ', '')), NULL, true,
       'K:' || (1000000 + p_partkey // 30)
FROM part GROUP BY p_partkey // 30""",
    "category": "SELECT CAST(n_nationkey AS BIGINT) AS category_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS parent_id FROM nation",
    "product": """
SELECT p_partkey AS product_id, p_name AS name, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
       CASE WHEN p_size % 10 = 0 THEN 0 WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS stock_quantity,
       p_size <> 1 AS is_active,
       CASE p_size % 4 WHEN 0 THEN '냉장' WHEN 1 THEN '냉동' WHEN 2 THEN '상온' END AS storage_type,
       p_size * 10 AS weight_g, p_size AS unit_count, p_type AS product_type, p_brand AS origin_country,
       p_partkey % 25 AS category_id, 'p/' || p_partkey || '.jpg' AS image_url
FROM part""",
    "product_ingredient": """
SELECT p_partkey AS product_id, p_partkey // 3 AS ingredient_id, 'PRIMARY' AS role FROM part WHERE p_partkey % 17 <> 0
UNION ALL
SELECT p_partkey, p_partkey // 3 + 1, CASE WHEN p_partkey % 2 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END
FROM part WHERE p_partkey % 11 = 0 AND p_partkey + 3 < (SELECT count(*) FROM part)""",
    "recipe": """
SELECT o_orderkey AS recipe_id, o_orderpriority || ' ' || o_orderkey AS name,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(5 + o_orderkey % 60 AS INTEGER) END AS cook_time_min,
       CAST(o_custkey % 30 AS INTEGER) AS prep_time_min, 1 + o_orderkey % 6 AS servings,
       o_orderpriority AS difficulty, o_orderstatus AS cooking_method, 'r/' || o_orderkey || '.jpg' AS image_url,
       CASE WHEN o_totalprice > 250000 THEN 'dish of ' || o_custkey END AS description,
       o_orderkey % 25 AS category_id
FROM orders""",
    "recipe_ingredient": f"""
SELECT l_orderkey AS recipe_id, {_LINE_INGREDIENT} AS ingredient_id, bool_or(l_returnflag <> 'R') AS is_required,
       max(l_quantity) AS quantity, 'g' AS unit, CASE WHEN max(l_tax) > 0.07 THEN 'sauce' END AS purpose
FROM lineitem GROUP BY 1, 2""",
    "recipe_step": """
SELECT DISTINCT l_orderkey AS recipe_id, l_linenumber AS step_no, 'step ' || l_linenumber AS instruction
FROM lineitem WHERE l_discount < 0.08""",
    "recipe_product": f"""
SELECT l_orderkey AS recipe_id, {_LINE_INGREDIENT} AS ingredient_id, l_partkey AS product_id,
       CAST(max(round(l_tax * 100)) AS INTEGER) AS recommendation_priority
FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1, 2, 3""",
    "user_fridge": """
SELECT o_custkey AS user_id, l_partkey AS product_id, sum(l_quantity) AS quantity, 'ea' AS unit,
       CASE WHEN max(l_linenumber) <> 7 THEN max(l_shipdate + to_days(CAST(l_quantity AS INTEGER))) END AS expires_at
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate >= TIMESTAMP '1997-11-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2""",
    "user_product_affinity": """
SELECT o_custkey AS user_id, l_partkey AS product_id, count(*) AS purchase_count,
       max(o_orderdate) AS last_purchased_at, least(1.0::DOUBLE, count(*) / 12.0::DOUBLE) AS affinity_score
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2""",
    "product_popularity": """
SELECT l_partkey AS product_id, date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS period_end,
       count(*) AS order_count, sum(l_quantity) AS popularity_score
FROM lineitem GROUP BY 1, 2""",
    "storage_staging": """
SELECT ingredient_id, storage_location, storage_context, source_item_id,
       'food ' || source_item_id % 7 AS source_food_name,
       CASE WHEN source_item_id % 3 = 0 THEN 'kind ' || source_item_id % 5 END AS source_food_subtitle,
       'slot' || lpad(CAST(source_item_id AS VARCHAR), 14, '0') AS source_slot,
       CAST(lo AS INTEGER) AS duration_min, CAST(hi + 1 AS INTEGER) AS duration_max,
       CASE line % 4 WHEN 0 THEN '시간' WHEN 1 THEN '일' WHEN 2 THEN '주' ELSE '개월' END AS duration_unit,
       CAST(lo AS INTEGER) || '-' || CAST(hi + 1 AS INTEGER) AS duration_text,
       CASE WHEN discount > 0.05 THEN 'tip ' || source_item_id % 100 END AS storage_tips
FROM (SELECT l_partkey // 3 AS ingredient_id,
             CASE l_returnflag WHEN 'A' THEN '냉장' WHEN 'N' THEN '상온' ELSE '냉동' END AS storage_location,
             CASE l_linestatus WHEN 'O' THEN '일반' ELSE '개봉후' END AS storage_context,
             l_orderkey * 100000 + l_partkey AS source_item_id, min(l_quantity) AS lo, max(l_quantity) AS hi,
             min(l_linenumber) AS line, max(l_discount) AS discount
      FROM lineitem WHERE l_quantity <= 5 GROUP BY 1, 2, 3, 4)""",
    "staging_days": """
SELECT *, duration_max * CASE duration_unit WHEN '시간' THEN 1.0::DOUBLE / 24 WHEN '일' THEN 1 WHEN '주' THEN 7
       WHEN '개월' THEN 30 WHEN '년' THEN 365 ELSE 1 END AS days FROM storage_staging""",
    "storage_guideline": """
SELECT *, source_item_id AS storage_id FROM staging_days
QUALIFY row_number() OVER (PARTITION BY ingredient_id, storage_location, storage_context
        ORDER BY days NULLS LAST, source_food_name, coalesce(source_food_subtitle, ''), source_slot) = 1""",
    "bubble_keyword": """
SELECT * FROM (VALUES
 ('LOW_INGREDIENT', 'few ingredients', 'at most three', 10, 1), ('FEW_STEPS', 'few steps', 'at most two steps', 10, 2),
 ('LIGHT', 'light', 'mostly light', 10, 3), ('MEAT', 'meat', 'with meat', 10, 4),
 ('QUICK_15MIN', 'quick', 'in 15 minutes', 10, 5), ('FOR_TWO', 'for two', 'two servings', 100000, 6),
 ('UNKNOWN_RULE', 'unknown', 'no rule', 10, 7))
 AS t(keyword_id, label, description, min_candidates, display_order)""",
    "user_recipe_view": """
SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS recipe_id, max(ts) AS viewed_at
FROM events WHERE event_type = 'view' GROUP BY 1, 2""",
    "user_recipe_favorite": """
SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS recipe_id, min(ts) AS created_at
FROM events WHERE event_type = 'click' GROUP BY 1, 2""",
    "requests": """
SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS recipe_id,
       CASE WHEN value < 100 THEN CAST(floor(value * 10) AS BIGINT) END AS base_product_id
FROM events WHERE event_type = 'view'""",
    "links_up": """
SELECT DISTINCT pi.product_id, u.ingredient_id FROM product_ingredient pi
LEFT JOIN ingredient i USING (ingredient_id),
LATERAL (SELECT unnest([pi.ingredient_id, i.parent_ingredient_id]) AS ingredient_id) u
WHERE pi.role = 'PRIMARY' AND u.ingredient_id IS NOT NULL""",
    "held": f"""
SELECT DISTINCT user_id, ingredient_id FROM user_fridge JOIN links_up USING (product_id)
WHERE expires_at IS NULL OR expires_at >= {AS_OF}""",
    "user_lines": """
SELECT c.user_id, ri.recipe_id, ri.ingredient_id, i.name AS ingredient_name, i.is_pantry,
       h.ingredient_id IS NOT NULL AS in_fridge
FROM (SELECT DISTINCT user_id, recipe_id FROM held JOIN recipe_ingredient USING (ingredient_id) WHERE is_required) c
JOIN recipe_ingredient ri ON ri.recipe_id = c.recipe_id AND ri.is_required
JOIN ingredient i ON i.ingredient_id = ri.ingredient_id
LEFT JOIN held h ON h.user_id = c.user_id AND h.ingredient_id = ri.ingredient_id""",
    "user_match": """
SELECT user_id, recipe_id, count(*) AS required_count, count(*) FILTER (WHERE in_fridge OR is_pantry) AS covered_count,
       count(*) FILTER (WHERE NOT in_fridge AND NOT is_pantry) AS missing_count
FROM user_lines GROUP BY 1, 2""",
    "category_count": """
SELECT ri.recipe_id, c.name AS category_name, count(*) AS n FROM recipe_ingredient ri
JOIN ingredient i USING (ingredient_id) LEFT JOIN category c ON c.category_id = i.ingredient_category_id
WHERE NOT i.is_pantry GROUP BY 1, 2""",
    "measures": """
SELECT r.*, coalesce(s.steps, 0) AS step_count, coalesce(g.total, 0) AS ingredient_count, g.light, g.meat
FROM recipe r
LEFT JOIN (SELECT recipe_id, CAST(sum(n) AS BIGINT) AS total,
                  coalesce(sum(n) FILTER (WHERE category_name IN ('NATION_0','NATION_1','NATION_2','NATION_3',
                           'NATION_4','NATION_5','NATION_6','NATION_7')), 0) AS light,
                  coalesce(sum(n) FILTER (WHERE category_name = 'NATION_3'), 0) AS meat
           FROM category_count GROUP BY 1) g USING (recipe_id)
LEFT JOIN (SELECT recipe_id, count(*) AS steps FROM recipe_step GROUP BY 1) s USING (recipe_id)""",
    "bubble_candidate": """
SELECT 'LOW_INGREDIENT' AS keyword_id, * FROM measures WHERE ingredient_count > 0 AND ingredient_count <= 3
UNION ALL SELECT 'FEW_STEPS', * FROM measures WHERE step_count > 0 AND step_count <= 2
UNION ALL SELECT 'LIGHT', * FROM measures WHERE ingredient_count > 0 AND light::DOUBLE / ingredient_count >= 0.6
UNION ALL SELECT 'MEAT', * FROM measures WHERE meat > 0
UNION ALL SELECT 'QUICK_15MIN', * FROM measures WHERE cook_time_min <= 15
UNION ALL SELECT 'FOR_TWO', * FROM measures WHERE servings <= 2""",
    "request_lines": """
SELECT q.user_id, q.recipe_id, q.base_product_id, ri.ingredient_id, i.name AS ingredient_name, ri.quantity, ri.unit,
       ri.is_required,
       CASE WHEN b.ingredient_id IS NOT NULL THEN 'BASE' WHEN h.ingredient_id IS NOT NULL THEN 'IN_FRIDGE'
            WHEN i.is_pantry THEN 'PANTRY' ELSE 'MISSING' END AS status
FROM requests q JOIN recipe_ingredient ri USING (recipe_id) JOIN ingredient i USING (ingredient_id)
LEFT JOIN links_up b ON b.product_id = q.base_product_id AND b.ingredient_id = ri.ingredient_id
LEFT JOIN held h ON h.user_id = q.user_id AND h.ingredient_id = ri.ingredient_id""",
    "offers": """
SELECT pi.ingredient_id, p.product_id, p.name AS product_name, p.price, coalesce(pop.popularity_score, 0) AS popularity_score
FROM product_ingredient pi JOIN product p USING (product_id)
LEFT JOIN (SELECT product_id, popularity_score FROM product_popularity
           QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY period_end DESC) = 1) pop USING (product_id)
WHERE pi.role = 'PRIMARY' AND p.is_active AND (p.stock_quantity IS NULL OR p.stock_quantity > 0)""",
}



def _uses(sql: str, name: str) -> bool:
    import re

    return re.search(rf"(?<![\w.']){name}(?![\w'(])", sql) is not None


def with_tables(sql: str) -> str:
    """``sql`` preceded by the bound tables it uses, directly or through other bound tables."""
    wanted: set[str] = set()
    queue = [n for n in CTES if _uses(sql, n)]
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += [n for n in CTES if n != name and _uses(CTES[name], n)]
    if not wanted:
        return sql
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in wanted]
    joined = ",\n".join(parts)
    stripped = sql.lstrip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + joined + ",\n" + stripped[len("WITH RECURSIVE "):]
    if stripped.upper().startswith("WITH "):
        return "WITH " + joined + ",\n" + stripped[len("WITH "):]
    return "WITH " + joined + "\n" + stripped
