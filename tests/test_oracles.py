"""Every registered query against its oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from tools.compare import compare, database

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
# nothing to find in the smallest tables
MAY_BE_EMPTY = {"judged_answers", "embedding_targets", "vector_topk_cosine", "unanswered_names"}


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok or (name in MAY_BE_EMPTY and "EMPTY" in message), message


@pytest.mark.parametrize(
    "name", ["fridge_recipe_match", "my_recipe_candidates", "product_recipes", "bubble_products", "exact_match"]
)
def test_no_pair_joins(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
