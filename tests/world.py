"""A small seeded catalog: five ingredients, eight products, three recipes, one user."""

from datetime import datetime, timedelta

from mealgrid.core.catalog import Catalog

NOW = datetime(2026, 9, 1, 12, 0, 0)
KIMCHI, PORK, TOFU, SALT, SESAME = 1, 2, 3, 4, 5
TOFU_A, TOFU_B, TOFU_C, SESAME_A, KIMCHI_A, PORK_A, SESAME_B, SESAME_C = range(11, 19)
STEW, BRAISE, GRILL = 21, 22, 23
USER = 31


def days(n):
    return NOW + timedelta(days=n)


def seeded(spark, parents=None, extra_ingredients=(), links=None, fridge=None, lines=None):
    """The catalog; ``parents`` maps ingredient → parent."""
    parents = parents or {}
    base = [(KIMCHI, "김치", False), (PORK, "돼지고기", False), (TOFU, "두부", False), (SALT, "소금", True),
            (SESAME, "참기름", False), *extra_ingredients]
    ingredient = spark.createDataFrame(
        [(i, n, n, p, parents.get(i), 1, [n + " 별칭"], True, f"K:{i}") for i, n, p in base],
        "ingredient_id long, name string, normalized_name string, is_pantry boolean, parent_ingredient_id long, "
        "ingredient_category_id long, aliases array<string>, is_raw_material boolean, source_identity_key string",
    )
    products = [
        (TOFU_A, "두부 A", 3000, 10, True), (TOFU_B, "두부 B", 2500, 10, True), (TOFU_C, "두부 C", 1000, 10, False),
        (SESAME_A, "참기름 A", 5000, 0, True), (KIMCHI_A, "김치 A", 4000, 10, True), (PORK_A, "돼지 A", 12000, 10, True),
        (SESAME_B, "참기름 B", 8000, 5, True), (SESAME_C, "참기름 C", 9000, None, True),
    ]
    product = spark.createDataFrame(
        [(i, n, p, s, a, "냉장", 100, 1, "RAW", "KR", 1, None) for i, n, p, s, a in products],
        "product_id long, name string, price int, stock_quantity int, is_active boolean, storage_type string, "
        "weight_g int, unit_count int, product_type string, origin_country string, category_id long, image_url string",
    )
    links = links or {TOFU_A: TOFU, TOFU_B: TOFU, TOFU_C: TOFU, SESAME_A: SESAME, KIMCHI_A: KIMCHI, PORK_A: PORK,
                      SESAME_B: SESAME, SESAME_C: SESAME}
    product_ingredient = spark.createDataFrame(
        [(p, i, "PRIMARY") for p, i in links.items()], "product_id long, ingredient_id long, role string"
    )
    recipe = spark.createDataFrame(
        [(STEW, "김치찌개", 20), (BRAISE, "두부조림", 15), (GRILL, "돼지구이", 30)],
        "recipe_id long, name string, cook_time_min int",
    ).selectExpr("*", "CAST(NULL AS INT) AS prep_time_min", "2 AS servings", "'easy' AS difficulty",
                 "'끓이기' AS cooking_method", "CAST(NULL AS STRING) AS image_url", "1L AS category_id",
                 "CAST(NULL AS STRING) AS description", "array('국') AS tags")
    lines = lines or [(STEW, KIMCHI, True), (STEW, PORK, True), (STEW, TOFU, False), (BRAISE, TOFU, True),
                      (BRAISE, SESAME, True), (GRILL, PORK, True), (GRILL, SALT, True)]
    recipe_ingredient = spark.createDataFrame(
        [(r, i, 1.0, "g", q, None) for r, i, q in lines],
        "recipe_id long, ingredient_id long, quantity double, unit string, is_required boolean, purpose string",
    )
    fridge = fridge or [(USER, KIMCHI_A, days(7)), (USER, PORK_A, days(3)), (USER, TOFU_A, days(-1))]
    return Catalog(
        ingredient=ingredient,
        category=spark.createDataFrame([(1, "채소류")], "category_id long, name string"),
        product=product,
        product_ingredient=product_ingredient,
        recipe=recipe,
        recipe_ingredient=recipe_ingredient,
        recipe_step=spark.createDataFrame(
            [(STEW, 1, "썰기", None), (STEW, 2, "끓이기", None)],
            "recipe_id long, step_no int, instruction string, image_url string",
        ),
        recipe_product=spark.createDataFrame(
            [(BRAISE, TOFU, TOFU_A, 5)],
            "recipe_id long, ingredient_id long, product_id long, recommendation_priority int",
        ),
        storage_guideline=spark.createDataFrame(
            [(1, TOFU, "냉장", "일반", 3, 5, "일", "3-5일", None), (2, TOFU, "냉장", "구매후", 1, 1, "주", "1주", "tip")],
            "storage_id long, ingredient_id long, storage_location string, storage_context string, duration_min int, "
            "duration_max int, duration_unit string, duration_text string, storage_tips string",
        ),
        user_fridge=spark.createDataFrame(
            [(u, p, 1.0, "ea", e) for u, p, e in fridge],
            "user_id long, product_id long, quantity double, unit string, expires_at timestamp_ntz",
        ),
        user_product_affinity=spark.createDataFrame(
            [(USER, KIMCHI_A, 9, days(-60), 0.9), (USER, TOFU_A, 7, days(-45), 0.8), (USER, TOFU_B, 4, days(-10), 0.95),
             (USER, SESAME_A, 2, days(-90), 0.7)],
            "user_id long, product_id long, purchase_count int, last_purchased_at timestamp_ntz, affinity_score double",
        ),
        product_popularity=spark.createDataFrame(
            [(SESAME_B, NOW, 10.0), (SESAME_C, NOW, 900.0), (SESAME_C, days(-90), 1.0)],
            "product_id long, period_end timestamp_ntz, popularity_score double",
        ),
        bubble_keyword=spark.createDataFrame(
            [("FEW", "f", "", "ingredient_count", '{"value": 2}', 1, 1, True),
             ("OFF", "o", "", "ingredient_count", '{"value": 9}', 1, 2, False)],
            "keyword_id string, label string, description string, rule_type string, rule_spec string, "
            "min_candidates int, display_order int, is_active boolean",
        ),
        user_recipe_favorite=spark.createDataFrame(
            [(USER, STEW, days(-1))], "user_id long, recipe_id long, created_at timestamp_ntz"
        ),
        user_recipe_view=spark.createDataFrame(
            [(USER, STEW, days(-1)), (USER, GRILL, days(-2))], "user_id long, recipe_id long, viewed_at timestamp_ntz"
        ),
    )


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id long, recipe_id long, base_product_id long")
