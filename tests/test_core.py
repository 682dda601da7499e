"""Shared building blocks against brute force."""

from pyspark.sql import functions as F

from mealgrid.core import merge, nesting, numbering, ranking, skew
from mealgrid.plans import loading, quality


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_salted_join_equals_plain_join_under_heavy_skew(spark):
    left = spark.range(600).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS k", "id AS a")
    right = spark.range(300).selectExpr("CASE WHEN id % 3 = 1 THEN 7 ELSE id % 50 END AS k", "id AS b")
    hot = skew.hot_keys(left, right, ["k"])
    assert hot.count() < skew.HOT_SHARE
    assert 7 in {r.k for r in hot.collect()}
    salted = skew.salted_join(left, right, ["k"], ["a"], ["b"]).select("k", "a", "b")
    assert rows_of(salted) == rows_of(left.join(right, "k").select("k", "a", "b"))


def test_top_n_limits_each_key_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    best = ranking.top_n(df, ["k"], [F.col("v").desc()], 2)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert rows_of(best) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]


def test_page_with_total(spark):
    df = spark.range(20).selectExpr("id % 2 AS k", "id AS v")
    page = ranking.page_with_total(df, ["k"], [F.col("v").asc()], 2, 1, "total")
    assert rows_of(page) == [(0, 2, 10), (0, 4, 10), (1, 3, 10), (1, 5, 10)]


def test_global_row_number(spark):
    df = spark.range(1000).select(F.pmod(F.hash("id"), F.lit(97)).alias("v"), "id")
    numbered = numbering.global_row_number(df, [F.col("v").desc(), F.col("id").asc()]).collect()
    expected = sorted(((r.v, r.id) for r in numbered), key=lambda t: (-t[0], t[1]))
    assert [(r.v, r.id) for r in sorted(numbered, key=lambda r: r.row_no)] == expected
    assert sorted(r.row_no for r in numbered) == list(range(1, 1001))


def test_pages_hold_every_entry_once(spark):
    df = spark.range(500).selectExpr("CASE WHEN id < 400 THEN 1 ELSE 2 END AS k", "id AS v")
    paged = nesting.add_page(df, ["k"], {"v": F.col("v")}, entries=150)
    cells = paged.groupBy("k", "page").agg(nesting.nested({"v": F.col("v")}, {"v": F.col("v")}).alias("cell")).collect()
    assert {c.page for c in cells if c.k == 2} == {0}  # also where one page is enough
    assert {c.page: (c.cell[0]["v"], len(c.cell)) for c in cells if c.k == 1} == {0: (0, 150), 1: (150, 150), 2: (300, 100)}
    assert sorted(e["v"] for c in cells for e in c.cell) == list(range(500))
    assert all([e["v"] for e in c.cell] == sorted(e["v"] for e in c.cell) for c in cells)


def test_merge_rules_and_second_run(spark):
    target = spark.createDataFrame([(1, "a", 5, ["x"]), (2, "b", 6, ["y"])], "id int, name string, n int, tags array<string>")
    source = spark.createDataFrame([(2, None, 4, []), (3, "c", 1, ["z"])], "id int, name string, n int, tags array<string>")
    rules = {"name": merge.keep_if_null, "n": merge.overwrite, "tags": merge.keep_if_empty_list}
    once = merge.merge_table(target, source, ["id"], rules)
    assert sorted((r.id, r.name, r.n, r.tags, r.action) for r in once.collect()) == [
        (1, "a", 5, ["x"], "kept"), (2, "b", 4, ["y"], "updated"), (3, "c", 1, ["z"], "inserted")]
    twice = merge.merge_table(once.drop("action"), source, ["id"], rules)
    assert rows_of(twice.select("id", "name", "n")) == rows_of(once.select("id", "name", "n"))


def test_increment_and_patch(spark):
    target = spark.createDataFrame([(1, 5, "old"), (2, 6, "old")], "id int, n int, x string")
    source = spark.createDataFrame([(1, 2, None, True), (2, 2, None, False)], "id int, n int, x string, set_x boolean")
    rules = {"n": merge.increment, "x": merge.patch("set_x")}
    assert rows_of(merge.merge_table(target, source, ["id"], rules).select("id", "n", F.coalesce("x", F.lit("-")))) == [
        (1, 7, "-"), (2, 8, "old")]


def test_align_master_runs_once(spark):
    ingredient = spark.createDataFrame(
        [(1, "a", "a", True, ["x"], None, "K1")],
        "ingredient_id long, name string, normalized_name string, is_raw_material boolean, aliases array<string>, "
        "parent_ingredient_id long, source_identity_key string",
    )
    actions = spark.createDataFrame(
        [("K1", "RENAME", "b", True, "", ""), ("K2", "INSERT", "c", True, "p|q", "K1"), ("K3", "INSERT", "d", True, "", "KX")],
        "source_identity_key string, action string, name string, is_raw_material boolean, aliases string, "
        "parent_source_identity_key string",
    )
    plan = loading.alignment_plan(actions, ingredient)
    assert {(r.source_identity_key, r.problem) for r in plan.collect()} == {("K1", None), ("K2", None), ("K3", "parent missing")}
    good = loading.alignment_plan(actions.filter("source_identity_key <> 'K3'"), ingredient)
    aligned = loading.align_master(ingredient, good).drop("action")
    again = loading.alignment_plan(actions.filter("source_identity_key <> 'K3'"), aligned)
    assert again.count() == 0


def test_connected_groups_on_chain_and_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    members = spark.createDataFrame([(n,) for e in edges for n in e] + [(999,)], "name long").distinct()
    groups = quality.connected_groups(spark.createDataFrame(edges, "left long, right long"), members)
    found = {r.name: r.group for r in groups.collect()}
    assert {found[i] for i in range(41)} == {0}
    assert {found[i] for i in (100, 101, 102)} == {100}
    assert found[999] == 999


def test_connected_groups_equal_union_find(spark):
    from entries import checks
    from mealgrid.plans import quality

    edges = [(k, 1000 + k * 7 % 90) for k in range(120)] + [(k, k + 1) for k in range(2000, 2100)]
    root = {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    frame = spark.createDataFrame(edges, "left long, right long")
    members = frame.selectExpr("left AS name").union(frame.select("right")).distinct()
    got = {r["name"]: r["group"] for r in quality.connected_groups(frame, members).collect()}
    assert got == {n: find(n) for n in root}
    assert checks.QUERIES["connected_groups"](spark, "/root/testdata/sf0.001").count() > 0


def _odd_datasets(spark):
    long = "x" * 65
    left = [("pantry", "7" * 70, 1, long), (" ", "-8", None, long + "y"), (None, "9", 3, "é"), ("freeze", "", 4, "　\t")]
    return {
        "left": spark.createDataFrame(left, "slot string, code string, n int, text string"),
        "right": spark.createDataFrame([("pantry", long, 1.5), ("other", "z", None)], "slot string, text string, x double"),
        "blank": spark.createDataFrame([("", None), (" ", None)], "slot string, empty int"),
        "own": spark.createDataFrame([(True, ["pantry"])], "flag boolean, list array<string>"),
    }


def test_slot_values_decide_like_all_distinct_values(spark):
    datasets = _odd_datasets(spark)
    every = quality.distinct_values(datasets)
    assert rows_of(quality.slot_columns(quality.slot_values(datasets))) == rows_of(quality.slot_columns(every)) == [("left", "slot")]
    assert rows_of(quality.slot_values(datasets).select("dataset", "column").distinct()) == rows_of(every.select("dataset", "column").distinct())


def test_shared_columns_are_enough_for_companions(spark):
    datasets = _odd_datasets(spark)
    shared = quality.shared_columns(datasets)
    assert shared == {"slot", "text"}
    every, some = quality.distinct_values(datasets), quality.distinct_values(datasets, shared)
    assert rows_of(some) == [r for r in rows_of(every) if r[1] in shared]
    # long values by digest, so that texts need no room, except whole numbers, which must be known as such
    assert max(len(r.value) for r in every.filter("column <> 'code'").collect()) == 71
    assert {r.column for r in quality.surrogate_columns(every).filter("is_surrogate").collect()} == {"code", "n"}
    metadata = spark.createDataFrame([(n, df.columns, df.count()) for n, df in datasets.items()], "name string, columns array<string>, row_count long")
    assert rows_of(quality.companion_datasets(some, metadata, 0.3)) == rows_of(quality.companion_datasets(every, metadata, 0.3)) == [("left", "right")]
    assert quality.distinct_values(datasets, set()).count() == 0


def test_profiles_store_no_texts(spark, monkeypatch):
    from entries import checks

    stored = []

    def seen(keep):
        return lambda df, *purpose: stored.append(df) or keep(df, *purpose)

    for name in ("durable", "written"):
        monkeypatch.setattr(checks, name, seen(getattr(checks, name)))
    assert checks.QUERIES["constrained_profiles"](spark, "/root/testdata/sf0.001").count() == 5
    values = [df for df in stored if "value" in df.columns]
    assert len(values) == 1
    held = values[0].groupBy("column").agg(F.max(F.octet_length("value")).alias("n")).collect()
    assert {"text", "c_name", "p_name"} <= {r.column for r in held}  # columns of several tables
    assert not {"l_orderkey", "html", "event_id"} & {r.column for r in held}
    assert max(r.n for r in held) == 71  # a digest
