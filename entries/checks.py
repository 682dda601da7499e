"""Data-quality checks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.binding import AS_OF, SCHEMAS, TABLES, bind, table, view
from entries.registry import Registry, joined
from mealgrid.core.scratch import durable, written
from mealgrid.functions import fixed_values as fixed
from mealgrid.functions.reasons import case_fingerprint
from mealgrid.plans import bubbles, quality, recommend

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles



# derived tables that share columns with given ones or copy one
DERIVED = {
    "part_copy": "SELECT * FROM {part}",
    "part_half": "SELECT p_name, p_type AS half_type FROM {part} WHERE p_size > 20",
    "customer_card": "SELECT c_name, c_mktsegment AS segment FROM {customer}",
    "slots": """SELECT concat('s', o_orderkey) AS slot_id,
        CASE o_orderstatus WHEN 'O' THEN 'pantry' WHEN 'F' THEN 'freeze' ELSE 'dop_freeze' END AS slot FROM {orders}""",
}
DERIVED_COLUMNS = {"part_half": ["p_name", "half_type"], "customer_card": ["c_name", "segment"], "slots": ["slot_id", "slot"]}


def _datasets(spark, sf):
    """All given tables and the derived ones."""
    return {n: table(spark, sf, n) for n in TABLES} | {n: view(spark, sf, text) for n, text in DERIVED.items()}


def _described() -> str:
    """DuckDB tables ``described`` (name, columns, row_count) and ``cells`` (dataset, "column", value) of all datasets."""
    columns = {n: [c.split()[0] for c in ddl.split(", ")] for n, ddl in SCHEMAS.items()}
    columns |= {"part_copy": columns["part"], **DERIVED_COLUMNS}
    source = {n: n for n in TABLES} | {n: "(" + text.format(part="part", customer="customer", orders="orders") + ")" for n, text in DERIVED.items()}
    described = [f"SELECT '{n}' AS name, {sorted(columns[n])} AS columns, count(*) AS row_count FROM {source[n]}" for n in columns]
    cells = [
        f"""SELECT DISTINCT '{n}' AS dataset, '{c}' AS "column", CAST({c} AS VARCHAR) AS value FROM {source[n]} WHERE trim(CAST({c} AS VARCHAR)) <> ''"""
        for n in columns for c in columns[n]
    ]
    return f"described AS ({' UNION ALL '.join(described)}), cells AS ({' UNION ALL '.join(cells)})"


DESCRIBED = _described()
SIZES_SQL = """sizes AS (SELECT dataset, "column", bool_and(regexp_matches(value, '^-*\\d+$')) AS is_surrogate, count(*) AS n FROM cells GROUP BY 1, 2)"""
COPIES_SQL = """copies AS (SELECT min(name) OVER g AS copy_group, name, count(*) OVER g AS k FROM described WINDOW g AS (PARTITION BY columns, row_count))"""


def _metadata(spark, sf):
    result = None
    for name, df in _datasets(spark, sf).items():
        row = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("name"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"), "row_count"
        )
        result = row if result is None else result.unionByName(row)
    return result


@register("duplicate_datasets", f"WITH {DESCRIBED}, {COPIES_SQL} SELECT copy_group, name FROM copies WHERE k > 1")
def duplicate_datasets(spark, sf):
    return quality.duplicate_datasets(_metadata(spark, sf))


@register("surrogate_columns", f"WITH {DESCRIBED}, {SIZES_SQL} SELECT * FROM sizes")
def surrogate_columns(spark, sf):
    return quality.surrogate_columns(quality.distinct_values(_datasets(spark, sf)))


@register(
    "companion_datasets",
    f"""WITH {DESCRIBED}, {SIZES_SQL}, {COPIES_SQL},
useful AS (SELECT cells.* FROM cells JOIN sizes USING (dataset, "column") WHERE NOT is_surrogate),
shared AS (SELECT a."column", a.dataset AS "left", b.dataset AS "right", count(*) AS n FROM useful a JOIN useful b
  ON a."column" = b."column" AND a.value = b.value AND a.dataset < b.dataset GROUP BY 1, 2, 3)
SELECT DISTINCT "left", "right" FROM shared s JOIN sizes x ON x.dataset = "left" AND x."column" = s."column" JOIN sizes y ON y.dataset = "right" AND y."column" = s."column"
JOIN copies c ON c.name = "left" JOIN copies d ON d.name = "right" WHERE s.n >= 0.8 * least(x.n, y.n) AND c.copy_group <> d.copy_group""",
)
def companion_datasets(spark, sf):
    return quality.companion_datasets(quality.distinct_values(_datasets(spark, sf)), _metadata(spark, sf))


@register(
    "slot_columns",
    f"""WITH {DESCRIBED} SELECT dataset, min("column") AS "column" FROM (
  SELECT dataset, "column" FROM cells GROUP BY 1, 2 HAVING bool_and(value IN {tuple(fixed.STORAGE_SLOTS)})) GROUP BY 1""",
)
def slot_columns(spark, sf):
    return quality.slot_columns(quality.distinct_values(_datasets(spark, sf)))


@register("connected_groups")  # no oracle: walking the whole graph is too slow in SQL; tests/test_core.py compares it
def connected_groups(spark, sf):
    edges = view(spark, sf, "SELECT DISTINCT l_orderkey AS left, l_partkey + 10000000 AS right FROM {lineitem}")
    members = edges.select(F.col("left").alias("name")).union(edges.select("right")).distinct()
    return quality.connected_groups(edges, members)


PROFILE_SQL = """SELECT 'customer' AS dataset, true AS loadable, 'recipe|recipe_ingredient' AS target_tables, 'c_name' AS group_by_columns, 'unknown_column|recipe_fk' AS rules
UNION ALL SELECT 'customer_card', false, 'none', 'c_name', 'companion_pair|companion_primary'
UNION ALL SELECT 'labels', false, 'none', '', 'missing_group_key'
UNION ALL SELECT 'nation', false, 'none', 'n_name', 'storage_source'
UNION ALL SELECT 'slots', true, 'storage_guideline', '', 'slot_not_a_key'"""


@register("constrained_profiles", PROFILE_SQL)
def constrained_profiles(spark, sf):
    profiles = view(spark, sf, """SELECT dataset, dataset IN ('customer', 'labels', 'nation', 'slots') AS loadable,
      CASE WHEN dataset = 'labels' THEN 'many' ELSE 'one' END AS rows_per_entity,
      CASE dataset WHEN 'customer' THEN array('recipe_ingredient') WHEN 'labels' THEN array('recipe')
        WHEN 'customer_card' THEN array('none') ELSE array('storage_guideline') END AS target_tables,
      CASE dataset WHEN 'customer' THEN array('c_name', 'nope') WHEN 'customer_card' THEN array('c_name')
        WHEN 'slots' THEN array('slot') WHEN 'nation' THEN array('n_name') ELSE CAST(array() AS ARRAY<STRING>) END AS group_by_columns,
      CAST(array() AS ARRAY<STRING>) AS entity_key_columns, dataset = 'customer_card' AS targets_recipe
      FROM (SELECT explode(array('customer', 'customer_card', 'labels', 'nation', 'slots')) AS dataset FROM {region} WHERE r_regionkey = 0)""")
    datasets = _datasets(spark, sf)
    values = written(quality.distinct_values(datasets, quality.shared_columns(datasets)), "values")
    metadata = durable(_metadata(spark, sf))
    companions = durable(quality.companion_datasets(values, metadata))
    slots = durable(quality.slot_columns(quality.slot_values(datasets)))
    rows = quality.constrained_profiles(profiles, metadata, companions, slots)
    return rows.select("dataset", "loadable", joined("target_tables"), joined("group_by_columns"), joined("rules"))


@register(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "violation_counts",
    """SELECT 'order before 1993' AS rule, count(*) AS offending FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'
UNION ALL SELECT 'unknown status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'negative total', count(*) FROM orders WHERE o_totalprice < 0""",
)
def violation_counts(spark, sf):
    return quality.violation_counts(
        table(spark, sf, "orders"),
        {
            "order before 1993": F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1993-01-01 00:00:00")),
            "unknown status": ~F.col("o_orderstatus").isin("F", "O"),
            "negative total": F.col("o_totalprice") < 0,
        },
    )


@register(
    "constraint_guards",
    """SELECT 'duplicate ingredient key' AS rule, 0::BIGINT AS offending
UNION ALL SELECT 'duplicate product key', count(*) FROM (SELECT name FROM product GROUP BY name, product_type HAVING count(*) > 1)
UNION ALL SELECT 'orphan parent', count(*) FROM ingredient WHERE parent_ingredient_id IS NOT NULL AND parent_ingredient_id NOT IN (SELECT ingredient_id FROM ingredient)
UNION ALL SELECT 'own parent', count(*) FROM ingredient WHERE parent_ingredient_id = ingredient_id
UNION ALL SELECT 'negative stock', count(*) FROM product WHERE stock_quantity < 0""",
)
def constraint_guards(spark, sf):
    catalog = bind(spark, sf)
    return quality.constraint_guards(catalog.ingredient, catalog.product, ["name", "product_type"])


@register(
    "deep_hierarchy",
    """SELECT p_partkey AS ingredient_id FROM part WHERE p_partkey > 0 AND p_partkey // 3 > 0""",
)
def deep_hierarchy(spark, sf):
    tree = table(spark, sf, "part").selectExpr(
        "p_partkey AS ingredient_id",
        "CASE WHEN p_partkey > 0 THEN CAST(floor(p_partkey / 3) AS BIGINT) END AS parent_ingredient_id",
    )
    return quality.deep_hierarchy(tree).select("ingredient_id")


@register(
    "missing_ids",
    "SELECT o_orderkey AS recipe_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def missing_ids(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("recipe_id"))
    existing = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recipe_id"))
    return quality.missing_ids(wanted, existing, "recipe_id")


@register(
    "set_differences",
    """SELECT user_id, recipe_id, 'unexpected' AS side FROM (SELECT user_id, recipe_id FROM user_recipe_view EXCEPT SELECT user_id, recipe_id FROM user_recipe_favorite)
UNION ALL SELECT user_id, recipe_id, 'missing' FROM (SELECT user_id, recipe_id FROM user_recipe_favorite EXCEPT SELECT user_id, recipe_id FROM user_recipe_view)""",
)
def set_differences(spark, sf):
    catalog = bind(spark, sf)
    return quality.set_differences(
        catalog.user_recipe_view, catalog.user_recipe_favorite, ["user_id", "recipe_id"]
    )


@register(
    "residue",
    """SELECT 'orders' AS table_name, count(*) AS residue FROM orders WHERE o_orderpriority LIKE '5%'
UNION ALL SELECT 'part', count(*) FROM part WHERE p_name LIKE 'red%'""",
)
def residue(spark, sf):
    return quality.residue(
        {
            "orders": (table(spark, sf, "orders"), F.col("o_orderpriority").startswith("5")),
            "part": (table(spark, sf, "part"), F.col("p_name").startswith("red")),
        }
    )


@register(
    "count_mismatches",
    """SELECT 'lines' AS table_name, (SELECT count(*) FROM lineitem) AS source_rows, (SELECT count(*) FROM recipe_ingredient) AS target_rows""",
)
def count_mismatches(spark, sf):
    catalog = bind(spark, sf)
    source = {"lines": table(spark, sf, "lineitem"), "orders": table(spark, sf, "orders")}
    return quality.count_mismatches(source, {"lines": catalog.recipe_ingredient, "orders": catalog.recipe})


@register(
    "filled_tables",
    """SELECT * FROM (SELECT 'high_tax' AS table_name, count(*) AS row_count FROM lineitem WHERE l_tax > 0.05
UNION ALL SELECT 'negative_price', count(*) FROM part WHERE p_retailprice < 0 UNION ALL SELECT 'labels', count(*) FROM labels) WHERE row_count > 0""",
)
def filled_tables(spark, sf):
    return quality.filled_tables(
        {
            "high_tax": table(spark, sf, "lineitem").filter("l_tax > 0.05"),
            "negative_price": table(spark, sf, "part").filter("p_retailprice < 0"),
            "labels": table(spark, sf, "labels"),
        }
    )


@register(
    "step_violations",
    """SELECT l_orderkey AS recipe_id, l_linenumber - 1 AS step_no, CASE WHEN l_linenumber < 2 THEN 'step_no' ELSE 'content' END AS problem
FROM lineitem WHERE l_linenumber < 2 OR (l_discount < 0.02 AND l_tax < 0.03)""",
)
def step_violations(spark, sf):
    steps = view(spark, sf, """SELECT l_orderkey AS recipe_id, l_linenumber - 1 AS step_no, CASE WHEN l_discount >= 0.02 THEN 'text' ELSE '  ' END AS instruction,
        CASE WHEN l_tax >= 0.03 THEN 'image' END AS image_url FROM {lineitem}""")
    return quality.step_violations(steps).select("recipe_id", "step_no", "problem")


@register(
    "most_guided_product",
    """SELECT product_id, count(*) AS rules FROM product_ingredient pi JOIN storage_guideline g USING (ingredient_id)
WHERE pi.role = 'PRIMARY' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def most_guided_product(spark, sf):
    from mealgrid.plans.storage import most_guided_product as pick

    catalog = bind(spark, sf)
    return pick(catalog.product_ingredient, catalog.storage_guideline)


@register(
    "recommendation_problems",
    """SELECT user_id, count(*) AS row_count, 0::BIGINT AS problems FROM user_match m JOIN recipe USING (recipe_id)
WHERE covered_count::DOUBLE / required_count >= 0.6 GROUP BY 1""",
)
def recommendation_problems(spark, sf):
    rows = quality.recommendation_problems(recommend.my_recipe_candidates(bind(spark, sf), AS_OF, 0.6))
    return rows.groupBy("user_id").agg(F.count("*").alias("row_count"), F.count("problem").alias("problems"))


@register(
    "case_drift",
    """SELECT CAST(doc_id AS VARCHAR) AS case_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.toxic = 1 THEN 'unverified'
  WHEN l.quality = 0 THEN 'drifted' ELSE 'same' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def case_drift(spark, sf):
    empty = F.array().cast("array<string>")

    def fingerprint(name):
        return case_fingerprint(name, F.lit(0.5), F.split(F.col("lang"), ""), empty, empty, F.lit(None), F.col("source"))

    documents = table(spark, sf, "documents")
    cases = documents.select(F.col("doc_id").cast("string").alias("case_id"), fingerprint(F.col("text")).alias("fingerprint"))
    shown = F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    results = documents.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").cast("string").alias("case_id"),
        F.when(F.col("toxic") == 1, "").otherwise(fingerprint(shown)).alias("case_hash"),
    )
    return quality.case_drift(cases, results).select("case_id", "status")


@register(
    "configured_products",
    """SELECT c.product_id, CASE WHEN p.product_id IS NULL THEN 'absent' WHEN p.name <> c.expected_name THEN 'other name'
  WHEN NOT EXISTS (SELECT 1 FROM product_ingredient pi JOIN ingredient i USING (ingredient_id) WHERE pi.product_id = c.product_id
       AND pi.role = 'PRIMARY' AND i.name = c.expected_ingredient) THEN 'other main ingredient' END AS problem
FROM (SELECT l_partkey + CASE WHEN max(l_tax) < 0.05 THEN 90000000 ELSE 0 END AS product_id,
        CASE WHEN p_size > 40 THEN 'x' ELSE p_name END AS expected_name, i.name AS expected_ingredient
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN ingredient i ON i.ingredient_id = CAST(p_partkey // 3 AS BIGINT)
      GROUP BY l_partkey, p_size, p_name, i.name) c LEFT JOIN product p USING (product_id)""",
)
def configured_products(spark, sf):
    catalog = bind(spark, sf)
    config = view(spark, sf, """SELECT l_partkey + CASE WHEN max(l_tax) < 0.05 THEN 90000000 ELSE 0 END AS product_id,
        CASE WHEN p_size > 40 THEN 'x' ELSE p_name END AS expected_name, CAST(floor(l_partkey / 3) AS BIGINT) AS ingredient_id
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_partkey, p_size, p_name""")
    config = config.join(
        catalog.ingredient.select("ingredient_id", F.col("name").alias("expected_ingredient")), "ingredient_id"
    )
    return quality.configured_products(config.drop("ingredient_id"), catalog).select("product_id", "problem")


@register(
    "scenario_checks",
    """WITH expected AS (SELECT DISTINCT user_id, recipe_id, ingredient_id, product_id FROM (SELECT DISTINCT user_id, recipe_id FROM request_lines)
   JOIN recipe_product USING (recipe_id)),
w AS (SELECT DISTINCT user_id, recipe_id, ingredient_id FROM expected),
pairs AS (SELECT DISTINCT user_id, recipe_id FROM expected),
miss AS (SELECT p.user_id, p.recipe_id, ri.ingredient_id FROM pairs p JOIN recipe_ingredient ri USING (recipe_id) JOIN ingredient i USING (ingredient_id)
  WHERE ri.is_required AND NOT i.is_pantry AND NOT EXISTS (SELECT 1 FROM held h WHERE h.user_id = p.user_id AND h.ingredient_id = ri.ingredient_id)),
off AS (SELECT user_id, recipe_id, count(*) AS n FROM ((SELECT * FROM miss EXCEPT SELECT * FROM w) UNION ALL (SELECT * FROM w EXCEPT SELECT * FROM miss)) GROUP BY 1, 2),
unb AS (SELECT user_id, recipe_id, count(*) AS n FROM w WHERE ingredient_id NOT IN (SELECT ingredient_id FROM offers) GROUP BY 1, 2),
unr AS (SELECT user_id, recipe_id, count(*) AS n FROM expected e WHERE NOT EXISTS (SELECT 1 FROM recipe_product r WHERE r.recipe_id = e.recipe_id
   AND r.product_id = e.product_id AND r.recommendation_priority = 4) GROUP BY 1, 2),
extra AS (SELECT user_id, count(*) AS n FROM user_fridge JOIN product USING (product_id) WHERE is_active AND (user_id + product_id) % 40 = 0 GROUP BY 1),
far AS (SELECT user_id, count(DISTINCT i.parent_ingredient_id) AS n FROM user_fridge f JOIN product_ingredient pi USING (product_id) JOIN ingredient i USING (ingredient_id)
  WHERE pi.role = 'PRIMARY' AND i.parent_ingredient_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM held h WHERE h.user_id = f.user_id AND h.ingredient_id = i.parent_ingredient_id) GROUP BY 1),
x AS (
  SELECT user_id, recipe_id, 'user and recipe are there once' AS "check",
    (user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 3))::INT + (recipe_id NOT IN (SELECT recipe_id FROM recipe))::INT AS n FROM pairs
  UNION ALL SELECT user_id, recipe_id, 'recipes named as configured', (recipe_id % 30 = 0)::INT FROM pairs
  UNION ALL SELECT user_id, recipe_id, 'active products in the fridge as configured', n FROM pairs LEFT JOIN extra USING (user_id)
  UNION ALL SELECT user_id, recipe_id, 'held children reach their parents', n FROM pairs LEFT JOIN far USING (user_id)
  UNION ALL SELECT user_id, recipe_id, 'missing as configured', n FROM pairs LEFT JOIN off USING (user_id, recipe_id)
  UNION ALL SELECT user_id, recipe_id, 'every missing one buyable', n FROM pairs LEFT JOIN unb USING (user_id, recipe_id)
  UNION ALL SELECT user_id, recipe_id, 'designated priority', n FROM pairs LEFT JOIN unr USING (user_id, recipe_id)
  UNION ALL SELECT user_id, recipe_id, 'hierarchy of one level', (SELECT count(*) FROM ingredient c JOIN ingredient i
    ON i.ingredient_id = c.parent_ingredient_id WHERE i.parent_ingredient_id IS NOT NULL) FROM pairs
)
SELECT user_id, recipe_id, "check", coalesce(n, 0)::BIGINT AS off, coalesce(n, 0) = 0 AS passed FROM x""",
)
def scenario_checks(spark, sf):
    catalog = bind(spark, sf)
    viewed = catalog.user_recipe_view.select("user_id", "recipe_id")
    expected = viewed.join(
        catalog.recipe_product.select("recipe_id", "ingredient_id", "product_id"), "recipe_id"
    ).distinct()
    # configured: some users and spellings that are not there, some stock that is not listed
    users = table(spark, sf, "customer").where("c_custkey % 50 <> 3").selectExpr("c_custkey AS user_id")
    named = catalog.recipe.selectExpr("recipe_id", "CASE WHEN recipe_id % 30 = 0 THEN 'other' ELSE name END AS name")
    active = catalog.user_fridge.join(catalog.product.where("is_active"), "product_id", "left_semi")
    stocked = active.where("(user_id + product_id) % 40 <> 0").select("user_id", "product_id")
    parents = (
        catalog.user_fridge.join(catalog.product_ingredient.where("role = 'PRIMARY'"), "product_id")
        .join(catalog.ingredient.where("parent_ingredient_id IS NOT NULL"), "ingredient_id")
        .selectExpr("user_id", "parent_ingredient_id AS ingredient_id")
        .distinct()
    )
    return quality.scenario_checks(catalog, recommend.owned_by_user(catalog, AS_OF), expected, 4, users, named, stocked, parents)


@register(
    "bubble_counts_agree",
    "SELECT keyword_id, count(c.recipe_id) AS candidates, true AS agrees FROM bubble_keyword LEFT JOIN bubble_candidate c USING (keyword_id) GROUP BY 1",
)
def bubble_counts_agree(spark, sf):
    catalog = bind(spark, sf)
    listed = bubbles.bubble_recipe_candidates_all(catalog).groupBy("keyword_id").agg(F.count("*").alias("listed"))
    counts = bubbles.bubble_candidate_counts(catalog).join(listed, "keyword_id", "left")
    agrees = F.col("candidates") == F.coalesce("listed", F.lit(0))
    return counts.select("keyword_id", "candidates", agrees.alias("agrees"))


@register(
    "edible_categories",
    """SELECT o_orderkey AS category_id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority LIKE '1%')""",
)
def edible_categories(spark, sf):
    from mealgrid.operators.filters import edible_categories as edible

    categories = view(spark, sf, """SELECT o_orderkey AS category_id, to_json(named_struct('source', o_orderstatus,
        'is_edible', NOT o_orderpriority LIKE '1%')) AS metadata FROM {orders}""")
    return edible(categories, "F").select("category_id")


@register(
    "steps_with_content",
    "SELECT l_orderkey, count(*) AS steps FROM lineitem WHERE l_discount >= 0.02 OR l_tax >= 0.03 GROUP BY 1",
)
def steps_with_content(spark, sf):
    from mealgrid.operators.filters import steps_with_content as with_content

    steps = view(spark, sf, """SELECT l_orderkey, CASE WHEN l_discount >= 0.02 THEN 'text' END AS instruction,
        CASE WHEN l_tax >= 0.03 THEN 'image' END AS image_url FROM {lineitem}""")
    return with_content(steps)[0].groupBy("l_orderkey").agg(F.count("*").alias("steps"))


@register(
    "complete_rows",
    "SELECT count(*) FILTER (WHERE o_totalprice <= 100000 OR o_orderstatus = 'P') AS skipped FROM orders",
)
def complete_rows(spark, sf):
    from mealgrid.operators.filters import complete_rows as complete

    rows = view(spark, sf, """SELECT CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS name FROM {orders}""")
    return complete(rows, ["price", "name"])[1]


