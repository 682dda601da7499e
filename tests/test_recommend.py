"""Recommendation behaviour on the seeded world."""

import pytest
from pyspark.sql import functions as F

import world as w
from mealgrid.operators import hierarchy
from mealgrid.plans import bubbles, details, recommend, storage


@pytest.fixture(scope="module")
def catalog(spark):
    return w.seeded(spark)


def names(column):
    return [e["name"] for e in column]


def test_expired_products_are_not_owned(spark, catalog):
    held = {r.ingredient_id for r in recommend.owned_by_user(catalog, w.NOW).collect()}
    assert held == {w.KIMCHI, w.PORK}


def test_coverage_counts_pantry_and_prunes_untouched_recipes(spark, catalog):
    rows = {r.recipe_id: r for r in recommend.fridge_recipe_match(catalog, w.NOW, 0.0, n=10).collect()}
    assert set(rows) == {w.STEW, w.GRILL}
    assert (rows[w.GRILL].covered_count, rows[w.GRILL].missing_count) == (2, 0)
    assert float(rows[w.STEW].coverage) == 1.0


def test_lists_are_disjoint_and_match_the_counts(spark, catalog):
    rows = {r.recipe_id: r for r in recommend.my_recipe_candidates(catalog, w.NOW).collect()}
    grill = rows[w.GRILL]
    assert names(grill.held_ingredients) == ["돼지고기"]
    assert names(grill.pantry_ingredients) == ["소금"]
    assert grill.missing_ingredients == []
    assert grill.available_count == 2


def test_status_order_of_sources(spark, catalog):
    asked = w.requests(spark, (w.USER, w.STEW, w.PORK_A), (None, w.GRILL, None))
    rows = {(r.recipe_id, r.ingredient_id): r.status for r in
            recommend.recipe_missing_ingredients(catalog, asked, w.NOW).collect()}
    assert rows[(w.STEW, w.PORK)] == "BASE"
    assert rows[(w.STEW, w.KIMCHI)] == "IN_FRIDGE"
    assert rows[(w.STEW, w.TOFU)] == "MISSING"
    assert rows[(w.GRILL, w.SALT)] == "PANTRY"
    assert rows[(w.GRILL, w.PORK)] == "MISSING"


def test_designated_product_wins_and_unsellable_ones_are_left_out(spark, catalog):
    asked = w.requests(spark, (w.USER, w.BRAISE, None))
    rows = recommend.missing_ingredient_products(catalog, asked, w.NOW, n=5).orderBy("rank_in_ingredient").collect()
    tofu = [r.product_id for r in rows if r.ingredient_id == w.TOFU]
    sesame = [r.product_id for r in rows if r.ingredient_id == w.SESAME]
    assert tofu == [w.TOFU_A, w.TOFU_B]
    assert sesame == [w.SESAME_C, w.SESAME_B]


def test_price_order_when_popularity_is_not_used(spark, catalog):
    rows = recommend.missing_products(catalog, w.requests(spark, (w.USER, w.BRAISE, w.TOFU_B)), w.NOW, n=5)
    assert [r.product_id for r in rows.orderBy("rank_in_ingredient").collect()] == [w.SESAME_B, w.SESAME_C]


def test_negative_priority_is_refused(spark, catalog):
    from dataclasses import replace

    bad = replace(catalog, recipe_product=catalog.recipe_product.withColumn("recommendation_priority", F.lit(-1)))
    with pytest.raises(Exception, match="negative recommendation priority"):
        recommend.missing_products(bad, w.requests(spark, (w.USER, w.BRAISE, None)), w.NOW, 1).collect()


def test_reorder_skips_recent_fresh_and_sold_out(spark, catalog):
    rows = recommend.reorder_candidates(catalog, w.NOW, days=30, n=10).collect()
    assert [(r.product_id, r.days_elapsed) for r in rows] == [(w.TOFU_A, 45)]


def test_child_covers_parent_but_not_the_reverse(spark):
    neck = 6
    extra = [(neck, "목심", False)]
    links = {w.KIMCHI_A: w.KIMCHI, w.PORK_A: neck}
    up = w.seeded(spark, parents={neck: w.PORK}, extra_ingredients=extra, links=links)
    assert {r.ingredient_id for r in recommend.owned_by_user(up, w.NOW).collect()} == {w.KIMCHI, neck, w.PORK}
    lines = [(w.GRILL, neck, True)]
    down = w.seeded(spark, parents={neck: w.PORK}, extra_ingredients=extra, lines=lines)
    assert recommend.fridge_recipe_match(down, w.NOW).count() == 0


def _missing(spark, catalog, closure):
    asked = w.requests(spark, (w.USER, w.STEW, None), (w.USER, w.BRAISE, None), (w.USER, w.GRILL, None))
    return sorted(
        (r.recipe_id, r.ingredient_id, r.product_id)
        for r in recommend.missing_products(catalog, asked, w.NOW, 3, closure).collect()
    )


def test_full_closure_equals_one_level_on_one_level_data(spark):
    catalog = w.seeded(spark, parents={w.PORK: w.SESAME})
    closure = hierarchy.ancestors(catalog.ingredient)
    assert _missing(spark, catalog, closure) == _missing(spark, catalog, None)


def test_grandparents_only_count_with_the_closure(spark):
    catalog = w.seeded(spark, parents={w.KIMCHI: w.SALT, w.SALT: w.SESAME})
    closure = hierarchy.ancestors(catalog.ingredient)
    assert {i for _, i, _ in _missing(spark, catalog, None)} - {i for _, i, _ in _missing(spark, catalog, closure)} == {
        w.SESAME
    }


def test_cycles_end(spark):
    catalog = w.seeded(spark, parents={w.KIMCHI: w.PORK, w.PORK: w.KIMCHI})
    pairs = {(r.ingredient_id, r.ancestor_id) for r in hierarchy.ancestors(catalog.ingredient).collect()}
    assert {(w.KIMCHI, w.PORK), (w.PORK, w.KIMCHI), (w.KIMCHI, w.KIMCHI)} <= pairs


def test_bubbles_count_what_they_list(spark, catalog):
    counts = {r.keyword_id: (r.candidates, r.is_servable) for r in bubbles.bubble_candidate_counts(catalog).collect()}
    listed = bubbles.bubble_recipe_candidates(catalog, 100).groupBy("keyword_id").count().collect()
    assert counts == {"FEW": (2, True)}
    assert {r.keyword_id: r["count"] for r in listed} == {"FEW": 2}


def test_details_have_empty_arrays(spark, catalog):
    recipes = {r.recipe_id: r for r in details.recipe_detail(catalog).collect()}
    assert recipes[w.GRILL].steps == []
    assert [s["step_no"] for s in recipes[w.STEW].steps] == [1, 2]
    assert [i["is_required"] for i in recipes[w.STEW].ingredients] == [True, True, False]


def test_two_main_ingredients_have_no_storage_rule(spark, catalog):
    rows = storage.product_storage_guideline(catalog).filter(F.col("product_id") == w.TOFU_A).collect()
    assert {(r.storage_context, r.duration_text) for r in rows} == {("일반", "3-5일"), ("구매후", "1주")}


def test_many_rule_blocks_give_the_same_candidates(spark, catalog, monkeypatch):
    from dataclasses import replace

    rules = spark.range(1, 8).selectExpr(
        "concat('B', id) AS keyword_id", "'l' AS label", "'' AS description",
        "CASE WHEN id % 2 = 0 THEN 'cook_time' ELSE 'ingredient_count' END AS rule_type",
        "concat('{\"value\": ', id * 4 - 3, '}') AS rule_spec", "1 AS min_candidates",
        "CAST(id AS INT) AS display_order", "true AS is_active",
    )
    many = replace(catalog, bubble_keyword=rules)
    found = lambda: sorted(
        (r.keyword_id, r.recipe_id) for r in bubbles.bubble_recipe_candidates_all(many).collect()
    )
    one_block = found()
    monkeypatch.setattr(bubbles, "RULES_PER_BLOCK", 2)
    assert found() == one_block
    assert len(one_block) > 5


def test_rare_lines_first_gives_the_same_pairs(spark):
    import random

    from mealgrid.plans import coverage

    rng = random.Random(3)
    # ingredient 0 and 1 are in every fridge and in every recipe
    owned = [(u, i) for u in range(60) for i in {0, 1, *rng.sample(range(2, 40), 6)}]
    lines = [(r, i, i % 7 == 0 and i > 0) for r in range(80) for i in {0, 1, *rng.sample(range(2, 40), rng.randrange(0, 7))}]
    owned = spark.createDataFrame(owned, "user_id long, ingredient_id long")
    lines = spark.createDataFrame(lines, "recipe_id long, ingredient_id long, is_pantry boolean")
    measured = coverage.measured_lines(lines, spark.range(80).selectExpr("id AS recipe_id", "id % 9 AS cook_time_min"))
    for least in (0.0, 0.3, 0.5, 0.8, 1.0):
        plain = coverage.coverage(owned, "user_id", measured).where(f"covered_count >= required_count * CAST({least} AS DECIMAL(10,6))")
        want = sorted(tuple(r) for r in plain.collect())
        found = coverage.coverage_at_least(owned, "user_id", measured, least).select(*plain.columns)
        assert sorted(tuple(r) for r in found.collect()) == want and want


def test_pages_of_designated_recipes(spark):
    """Products of one class differ in their designations only; pages equal those of all pairs ranked at once."""
    import random
    from types import SimpleNamespace

    rng = random.Random(5)
    links = [(p, p % 6, "PRIMARY") for p in range(30)]
    recipe_lines = [(r, i, True) for r in range(50) for i in {rng.randrange(9), rng.randrange(9), rng.randrange(9)}]
    designated = [(rng.randrange(50), 0, p, rng.randrange(5)) for p in range(0, 30, 2) for _ in range(3)]
    catalog = SimpleNamespace(
        product_ingredient=spark.createDataFrame(links, "product_id long, ingredient_id long, role string"),
        ingredient=spark.range(9).selectExpr("id AS ingredient_id", "CASE WHEN id < 3 THEN 6L + id END AS parent_ingredient_id", "id = 5 AS is_pantry"),
        recipe_product=spark.createDataFrame(designated, "recipe_id long, ingredient_id long, product_id long, recommendation_priority int").distinct(),
        recipe_ingredient=spark.createDataFrame(recipe_lines, "recipe_id long, ingredient_id long, is_required boolean"),
        recipe=spark.range(50).selectExpr("id AS recipe_id", "CAST(nullif(id % 4, 0) AS INT) AS cook_time_min", "'n' AS name", "'' AS image_url",
                                          "'' AS difficulty", "1 AS prep_time_min", "2 AS servings", "'' AS cooking_method"),
    )
    got = {}
    for r in recommend.product_recipes(catalog, n=4, skip=1).collect():
        got.setdefault(r.product_id, []).append((r.recipe_id, r.matched_count, r.missing_count, r.total_recipes))
    best = {}
    for r, _, p, x in designated:
        best[p, r] = max(best.get((p, r), 0), x)
    needs = {}
    for r, i, _ in recipe_lines:
        needs.setdefault(r, set()).add(i)
    for p in range(30):
        own = {p % 6} | ({6 + p % 6} if p % 6 < 3 else set())
        rows = []
        for r, lines in needs.items():
            if lines & own:
                missing = len([i for i in lines if i not in own and i != 5])
                cook = r % 4 or 99
                rows.append((-best.get((p, r), 0), missing, cook, r, len(lines) - missing))
        page = [(r, matched, missing, len(rows)) for _, missing, _, r, matched in sorted(rows)[1:5]]
        assert sorted(got.get(p, [])) == sorted(page)
