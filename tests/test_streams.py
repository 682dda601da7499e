"""Streaming jobs: batch equality, replays and the limiter."""

import random

from mealgrid.plans import loading
from mealgrid.streaming import jobs
from mealgrid.streaming.state import VersionedTable, each_batch

VIEWS = "user_id long, recipe_id long, viewed_at timestamp"


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "user_id long, product_id long, quantity long")
    batch = spark.createDataFrame([(1, 1, 5)], "user_id long, product_id long, quantity long")

    def add(state, incoming):
        return (
            state.unionByName(incoming).groupBy("user_id", "product_id").sum("quantity")
            .withColumnRenamed("sum(quantity)", "quantity")
        )

    run = each_batch(table, add)
    for batch_id in (0, 1, 1, 1):
        run(batch, batch_id)
    assert [r.quantity for r in table.read(spark).collect()] == [10]


def _add(state, incoming):
    both = state.unionByName(incoming.select("user_id", "product_id", "quantity"))
    return both.groupBy("user_id", "product_id").agg({"quantity": "sum"}).withColumnRenamed("sum(quantity)", "quantity")


STOCK = "user_id long, product_id long, quantity long"


def _sums(table, spark, **which):
    return sorted((r.user_id, r.quantity) for r in table.read(spark, **which).collect())


def _files(root):
    """Data files of a state table with the time of their last change."""
    import glob
    import os

    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/rows/slot=*/bucket=*/*.parquet")}


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    root = str(tmp_path / "t")
    table = VersionedTable(spark, root, STOCK, buckets=16)
    run = each_batch(table, _add)
    run(spark.range(400).selectExpr("id AS user_id", "1L AS product_id", "1L AS quantity"), 0)
    before = _files(root)
    run(spark.createDataFrame([(7, 1, 5)], STOCK), 1)
    after = _files(root)
    assert len(before) == 16 and {f: t for f, t in after.items() if f in before} == before and len(after) == 17
    assert _sums(table, spark) == [(k, 6 if k == 7 else 1) for k in range(400)]


def test_a_batch_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), STOCK, buckets=4)
    run = each_batch(table, _add)
    batch = spark.createDataFrame([(k, 1, 1) for k in range(20)], STOCK)
    run(batch, 0)
    run(batch, 1)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", dies)  # all rows are written, the version is not
        try:
            run(batch, 2)
        except RuntimeError:
            pass
    other = VersionedTable(spark, str(tmp_path / "t"), STOCK, buckets=4)  # opened again
    assert other.version(spark) == 1 and _sums(other, spark) == [(k, 2) for k in range(20)]
    for _ in range(2):
        each_batch(other, _add)(batch, 2)
        assert _sums(other, spark) == [(k, 3) for k in range(20)]
    assert _sums(other, spark, before=2) == [(k, 2) for k in range(20)]


def test_old_versions_do_not_pile_up(spark, tmp_path):
    root = str(tmp_path / "t")
    table = VersionedTable(spark, root, STOCK, buckets=2)
    run = each_batch(table, _add)
    for k in range(9):
        run(spark.createDataFrame([(1, 1, k), (2, 1, 1)], STOCK), k)
    assert len(_files(root)) <= 4 and _sums(table, spark) == [(1, 36), (2, 9)]
    # a bucket that loses all its rows is empty, whatever its slot held before
    each_batch(table, lambda state, batch: state.where("false"))(spark.createDataFrame([(1, 1, 1)], STOCK), 9)
    assert _sums(table, spark) == [(2, 9)]
    each_batch(table, _add)(spark.createDataFrame([], STOCK), 10)
    assert _sums(table, spark) == [(2, 9)] and table.version(spark) == 10


def test_adds_of_a_pair_are_bounded(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), jobs.FAVORITES_STATE, buckets=2)
    run = each_batch(table, jobs.favorites_step("3 days"))
    for k in range(4):
        days = spark.range(k * 25, k * 25 + 25).selectExpr("1L AS user_id", "1L AS recipe_id", "'add' AS op", "timestamp_seconds(id * 86400) AS ts")
        run(days, k)
    (row,) = table.read(spark).selectExpr("transform(adds, t -> unix_seconds(t) div 86400) AS days").collect()
    assert row.days == [0, 97, 98, 99]


def test_views_keep_the_newest_per_user(spark):
    state = spark.sql("SELECT 1L AS user_id, 1L AS recipe_id, TIMESTAMP'2024-01-01' AS viewed_at")
    seen = spark.sql(
        "SELECT 1L AS user_id, explode(array(1L, 2L, 3L)) AS recipe_id, TIMESTAMP'2024-01-02' AS viewed_at"
    )
    rows = loading.record_views(state, seen, keep=2)
    assert sorted(r.recipe_id for r in rows.collect()) == [2, 3]


def test_favorites_follow_times_in_any_order_of_arrival(spark, tmp_path):
    changes = [(1, 1, "add", 1), (1, 1, "remove", 3), (1, 1, "add", 4), (1, 1, "add", 5), (1, 2, "add", 2), (1, 2, "remove", 6),
               (1, 3, "add", 9), (1, 3, "remove", 2), (1, 3, "add", 1), (2, 1, "remove", 4)]
    rng = random.Random(1)
    for trial in range(3):
        rng.shuffle(changes)
        table = VersionedTable(spark, str(tmp_path / f"t{trial}"), jobs.FAVORITES_STATE)
        run = each_batch(table, jobs.favorites_step("30 days"))
        for n, k in enumerate((0, 4, 7)):
            part = changes[k : (4, 7, 10)[n]]
            batch = spark.createDataFrame(part, "user_id long, recipe_id long, op string, day int")
            run(batch.selectExpr("user_id", "recipe_id", "op", "timestamp_seconds(day * 86400) AS ts"), n)
        rows = jobs.favorites(table.read(spark)).selectExpr("recipe_id", "unix_seconds(created_at) div 86400 AS day").collect()
        assert sorted((r.recipe_id, r.day) for r in rows) == [(1, 4), (3, 9)]


def test_recent_requests_equal_brute_force(spark):
    events = spark.range(300).selectExpr(
        "id AS event_id", "id % 2 AS k", "timestamp_micros(id * id * 700000 % 400000000) AS ts"
    )
    rows = events.collect()
    counts = {r.event_id: r.requests for r in jobs.recent_requests(events, "k", "ts", "event_id").collect()}
    for r in rows:
        near = [o for o in rows if o.k == r.k and 0 <= (r.ts - o.ts).total_seconds() < 60]
        assert counts[r.event_id] == len(near)


def _limited(spark, tmp_path, rows, files):
    """Waits by event for (event_id, key, seconds) rows that arrive in ``files`` pieces."""
    schema = "event_id long, key string, t double"
    source = str(tmp_path / "in")
    for k in range(files):
        part = spark.createDataFrame(rows[k::files], schema).selectExpr("event_id", "key", "timestamp_micros(CAST((t + 1000) * 1e6 AS BIGINT)) AS ts")
        part.coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the first moves the watermark, with the second the waiting requests are decided
        spark.sql("SELECT -1L AS event_id, 'end' AS key, timestamp_seconds(9000000) AS ts").write.mode("append").parquet(source)
    stream = spark.readStream.schema("event_id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    jobs.run_to_end(jobs.admitted_requests(stream, 2, "30 days"), str(tmp_path / "ck"), jobs.collect_updates(out))
    return {r.event_id: r.retry_after for r in spark.read.parquet(out).collect()}


def test_limiter_does_not_record_refused_requests(spark, tmp_path):
    times = [0.0, 1.0, 2.0, 59.0, 60.5, 61.5, 62.0]
    waits = _limited(spark, tmp_path, [(i, "a", t) for i, t in enumerate(times)], 2)
    assert [waits[i] for i in range(7)] == [None, None, 58.0, 1.0, None, None, 58.5]


def test_limiter_with_more_requests_of_a_key_than_a_batch_holds(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "hot" if i % 4 else f"k{i % 40}", float(i * 7 % 25_000 * 5)) for i in range(25_000)]
    want, hits = {}, {}
    for i, key, now in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = hits[key] = [h for h in hits.get(key, []) if now - h < 60]
        want[i] = 60 - (now - mine[0]) if len(mine) >= 2 else None
        if want[i] is None:
            mine.append(now)
    rng.shuffle(rows)
    assert _limited(spark, tmp_path, rows, 3) == want


def test_late_rows_are_dropped(spark, tmp_path):
    log = "ts timestamp, route string, status int, duration_ms double"
    source = tmp_path / "in"
    for n, (ts, route) in enumerate([("2024-01-01 10:00:00", "/a"), ("2024-01-01 12:00:00", "/a"), ("2024-01-01 08:00:00", "/late")]):
        spark.sql(f"SELECT TIMESTAMP'{ts}' AS ts, '{route}' AS route, 200 AS status, 10.0D AS duration_ms").coalesce(1).write.mode(
            "append").parquet(str(source))
        stream = spark.readStream.schema(log).parquet(str(source))
        jobs.run_to_end(jobs.access_metrics(stream, "ts", "10 minutes", "1 hour"), str(tmp_path / "ck"),
                        jobs.collect_updates(str(tmp_path / f"out{n}")), "update")
    import os

    routes = set()
    for n in range(3):
        if os.path.isdir(tmp_path / f"out{n}"):
            routes |= {r.route for r in spark.read.parquet(str(tmp_path / f"out{n}")).collect()}
    assert routes == {"/a"}


def test_request_windows_equal_brute_force(spark, tmp_path):
    """Batches out of order, late rows, null keys and times, a batch that runs again: against windows counted one by one."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    start, delay = 1_704_067_200, 300
    batches = []
    for n in range(4):
        ends = [start + 400 * n, start + 400 * (n + 1)]
        times = [rng.uniform(*ends) for _ in range(60)] + [rng.uniform(start, ends[1]) for _ in range(20)] + [ends[1] - 1.0, None]
        batches.append([(rng.choice([1, 1, 2, 3, None]), None if t is None else round(t, 3)) for t in times])
    root = str(tmp_path / "updates")
    state = VersionedTable(spark, str(tmp_path / "state"), jobs.REQUEST_STATE)
    run = jobs.request_windows(state, root, "ts", f"{delay} seconds", 2)
    counts, newest, dropped = {}, None, 0
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "user_id long, t double").select("user_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"))
        for _ in range(2 if n == 2 else 1):
            run(frame, n)
        changed = {}
        for key, t in rows:
            for first in () if t is None else range(int(t // 10) * 10 - 50, int(t // 10) * 10 + 1, 10):
                if newest is None or first + 60 > newest - delay:
                    changed[first, key] = counts[first, key] = counts.get((first, key), 0) + 1
                else:
                    dropped += 1
        newest = max([t for _, t in rows if t] + [newest or 0])
        stored = spark.read.parquet(f"{root}/batch={n}").collect()
        assert sorted((int(r.window_start.timestamp()), str(r.user_id), r.requests, r.over_limit) for r in stored) == sorted(
            (f, str(k), c, c > 2) for (f, k), c in changed.items())
    assert dropped > 0
    latest = jobs.latest_updates(spark, root, ["window_start", "user_id"])
    assert latest.columns == ["window_start", "user_id", "requests", "over_limit"]
    assert {(int(r.window_start.timestamp()), r.user_id): r.requests for r in latest.collect()} == counts
    # one row per key and step that an open window still has, not one per window
    held = state.read(spark)
    assert held.count() == held.select("user_id", "step").distinct().count()
    assert held.agg(F.min("step")).first()[0] * 10 + 60 > start + 3 * 400 - 1 - delay - 60


def test_latest_updates_of_fixed_and_other_values(spark, tmp_path):
    for n, rows in enumerate([[(1, 5, "a"), (2, 6, None)], [(2, None, "b")], [(None, 1, "c")]]):
        spark.createDataFrame(rows, "k long, n long, s string").write.parquet(str(tmp_path / f"u/batch={n}"))
        spark.createDataFrame([r[:2] for r in rows], "k long, n long").write.parquet(str(tmp_path / f"v/batch={n}"))
    want = {1: (5, "a"), 2: (None, "b"), None: (1, "c")}
    assert {r.k: (r.n, r.s) for r in jobs.latest_updates(spark, str(tmp_path / "u"), ["k"]).collect()} == want
    assert {r.k: r.n for r in jobs.latest_updates(spark, str(tmp_path / "v"), ["k"]).collect()} == {k: n for k, (n, _) in want.items()}
