"""Streaming jobs fed with the given events (and line items) as files, run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.binding import bind, table, view
from entries.registry import Registry, num, stamp, stamp_sql
from mealgrid.core.scratch import new_folder
from mealgrid.streaming import jobs
from mealgrid.streaming.state import VersionedTable

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

FILES = 3
FAR_DELAY = "90 days"  # the files hold one month in no fixed order
NEAR_DELAY = "10 minutes"  # for files that follow each other in time


def _as_stream(spark, df, name: str, per_batch: int = 1):
    """A frame written as files and read back as a stream, in ``FILES / per_batch`` batches of as many files as the frame's size asks for."""
    folder = new_folder(spark, name)
    each = -(-df.rdd.getNumPartitions() // FILES)
    df.repartition(FILES * each).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch * each).parquet(folder)


def _in_order(spark, parts, name: str, run) -> None:
    """Frames that arrive one after the other: ``run(stream, checkpoint)`` goes on from where it was after each of them."""
    folder, checkpoint = new_folder(spark, name), new_folder(spark, "ck")
    for part in parts:
        part.write.mode("append").parquet(folder)
        run(spark.readStream.schema(part.schema).parquet(folder), checkpoint)


def _events(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint").alias("recipe_id")
    return table(spark, sf, "events").select("event_id", "user_id", k, "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


@register(
    "stream_recent_views",
    f"""SELECT user_id, recipe_id, {stamp_sql('viewed_at')} FROM user_recipe_view
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY viewed_at DESC, recipe_id DESC) <= 8""",
)
def stream_recent_views(spark, sf):
    bind(spark, sf)
    seen = _events(spark, sf).filter("event_type = 'view'").select("user_id", "recipe_id", F.col("ts").alias("viewed_at"))
    state = VersionedTable(spark, new_folder(spark, "views"), "user_id BIGINT, recipe_id BIGINT, viewed_at TIMESTAMP")
    jobs.keep_state(_as_stream(spark, seen, "view-events"), state, jobs.views_step(8), new_folder(spark, "ck"))
    return state.read(spark).select("user_id", "recipe_id", stamp("viewed_at"))


@register(
    "stream_favorites",
    f"""WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS recipe_id, event_type, ts FROM events WHERE event_type IN ('click', 'error')),
r AS (SELECT user_id, recipe_id, max(ts) AS removed FROM e WHERE event_type = 'error' GROUP BY 1, 2)
SELECT e.user_id, e.recipe_id, {stamp_sql('min(e.ts)', 'created_at')} FROM e LEFT JOIN r USING (user_id, recipe_id)
WHERE e.event_type = 'click' AND (removed IS NULL OR ts > removed) GROUP BY 1, 2""",
)
def stream_favorites(spark, sf):
    bind(spark, sf)
    op = F.when(F.col("event_type") == "click", "add").otherwise("remove").alias("op")
    changes = _events(spark, sf).filter("event_type IN ('click', 'error')").select("user_id", "recipe_id", op, "ts")
    state = VersionedTable(spark, new_folder(spark, "favorites"), jobs.FAVORITES_STATE)
    # several batches whose times overlap
    jobs.keep_state(_as_stream(spark, changes, "favorite-events"), state, jobs.favorites_step(FAR_DELAY), new_folder(spark, "ck"))
    return jobs.favorites(state.read(spark)).select("user_id", "recipe_id", stamp("created_at"))


PERIOD = "CASE WHEN l_shipdate < DATE '1994-06-01' THEN 0 WHEN l_shipdate < DATE '1996-09-01' THEN 1 ELSE 2 END"


@register(
    "stream_deliveries",
    f"""SELECT user_id, product_id, quantity, last.u AS unit, strftime(last.d, '%Y-%m-%d') AS expires_on, inserted, updated, skipped, reason FROM (
  SELECT o_custkey AS user_id, l_partkey AS product_id, CASE WHEN linked THEN CAST(sum(l_quantity) AS DOUBLE) END AS quantity,
    CASE WHEN linked THEN max({{'d': CAST(l_shipdate AS DATE), 'p': l_extendedprice, 'u': l_linestatus}}) END AS last,
    CASE WHEN linked THEN 1 ELSE 0 END AS inserted, CASE WHEN linked THEN count(DISTINCT {PERIOD}) - 1 ELSE 0 END AS updated,
    CASE WHEN linked THEN 0 ELSE count(DISTINCT {PERIOD}) END AS skipped, CASE WHEN NOT linked THEN 'NO_PRIMARY_INGREDIENT' END AS reason
  FROM (SELECT *, l_partkey IN (SELECT product_id FROM product_ingredient WHERE role = 'PRIMARY') AS linked
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY o_custkey, l_partkey, linked)""",
)
def stream_deliveries(spark, sf):
    catalog = bind(spark, sf)
    items = view(spark, sf, f"""SELECT o_custkey AS user_id, l_partkey AS product_id, CAST(l_quantity AS DECIMAL(18,3)) AS quantity, l_linestatus AS unit,
        CAST(l_shipdate AS TIMESTAMP) AS expires_at, true AS set_expiry, struct(l_shipdate, l_extendedprice) AS item_no, {PERIOD} AS period
        FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey""")
    fridge = VersionedTable(
        spark, new_folder(spark, "fridge"),
        "user_id BIGINT, product_id BIGINT, quantity DECIMAL(18,3), unit STRING, expires_at TIMESTAMP",
    )
    outcomes = new_folder(spark, "outcomes")
    run = jobs.delivery_batch(fridge, outcomes, catalog.product, catalog.product_ingredient)
    parts = [items.where(F.col("period") == k) for k in range(FILES)]
    _in_order(spark, parts, "deliveries", lambda stream, checkpoint: jobs.run_to_end(stream, checkpoint, run))
    happened = lambda action: F.count_if(F.col("action") == action).alias(action)
    told = spark.read.parquet(outcomes).groupBy("user_id", "product_id").agg(
        happened("inserted"), happened("updated"), happened("skipped"), F.max("reason").alias("reason")
    )
    held = fridge.read(spark).select(
        "user_id", "product_id", num("quantity"), "unit", F.date_format("expires_at", "yyyy-MM-dd").alias("expires_on")
    )
    return told.join(held, ["user_id", "product_id"], "left")


def _updates(spark, stream_result, keys):
    root = new_folder(spark, "updates")
    jobs.run_to_end(stream_result, new_folder(spark, "ck"), jobs.collect_updates(root), "update")
    return jobs.latest_updates(spark, root, keys)


@register(
    "stream_request_counts",
    """SELECT CAST(w AS BIGINT) AS window_start, user_id, count(*) AS requests, count(*) > 1 AS over_limit
FROM (SELECT user_id, unnest(generate_series(CAST(floor(epoch(ts) / 10) AS BIGINT) * 10 - 50, CAST(floor(epoch(ts) / 10) AS BIGINT) * 10, 10)) AS w FROM events) GROUP BY 1, 2""",
)
def stream_request_counts(spark, sf):
    bind(spark, sf)
    stream = _as_stream(spark, _events(spark, sf), "requests")
    state, root = VersionedTable(spark, new_folder(spark, "steps"), jobs.REQUEST_STATE), new_folder(spark, "updates")
    jobs.run_to_end(stream, new_folder(spark, "ck"), jobs.request_windows(state, root, "ts", FAR_DELAY, 1))
    counts = jobs.latest_updates(spark, root, ["window_start", "user_id"])
    return counts.withColumn("window_start", F.unix_seconds("window_start"))


@register(
    "recent_requests",
    """SELECT event_id, user_id, count(*) OVER w AS requests, (us - min(us) OVER w) / 1e6::DOUBLE AS oldest_age FROM (SELECT *, epoch_us(ts) AS us FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""",
)
def recent_requests(spark, sf):
    bind(spark, sf)
    return jobs.recent_requests(_events(spark, sf), "user_id", "ts", "event_id")


@register(
    "stream_admitted_requests",
    """WITH RECURSIVE e AS (SELECT event_id, user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (SELECT event_id, key, rn, NULL::BIGINT AS older, t AS newer, NULL::BIGINT AS wait FROM e WHERE rn = 1
  UNION ALL SELECT e.event_id, e.key, e.rn,
    CASE WHEN e.t - w.older < 172800000000 AND e.t - w.newer < 172800000000 THEN w.older WHEN e.t - w.newer < 172800000000 THEN w.newer END,
    CASE WHEN e.t - w.older < 172800000000 AND e.t - w.newer < 172800000000 THEN w.newer ELSE e.t END,
    CASE WHEN e.t - w.older < 172800000000 AND e.t - w.newer < 172800000000 THEN 172800000000 - (e.t - w.older) END
  FROM walk w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)
SELECT event_id, CAST(key AS VARCHAR) AS key, wait / 1e6::DOUBLE AS retry_after FROM walk""",
)
def stream_admitted_requests(spark, sf):
    """Two requests of a user in any two days; the log comes in the order of time, a request is decided ten minutes later."""
    bind(spark, sf)
    events = _events(spark, sf).select("event_id", F.col("user_id").cast("string").alias("key"), "ts")
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    share = (F.unix_micros("ts") - F.unix_micros(F.lit(ends.a))) / F.greatest(F.unix_micros(F.lit(ends.b)) - F.unix_micros(F.lit(ends.a)), F.lit(1))
    period = F.least(F.floor(share * FILES), F.lit(FILES - 1))
    parts = [events.where(period == k) for k in range(FILES)]
    # two requests days later: the first moves the watermark past all others, with the second the waiting ones are decided
    for days in (1, 2):
        end = events.agg((F.max("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"))
        parts.append(end.select(F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("key"), "ts"))
    root = new_folder(spark, "admitted")

    def run(stream, checkpoint):
        jobs.run_to_end(jobs.admitted_requests(stream, 2, NEAR_DELAY, 172_800), checkpoint, jobs.collect_updates(root))

    _in_order(spark, parts, "admissions", run)
    return spark.read.parquet(root).where("event_id >= 0").select("event_id", "key", "retry_after")


METRICS_SQL = """SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start, '/' || event_type AS route,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, count(*) AS requests, round(sum(value * 10), 3) AS duration_ms,
  count(*) FILTER (WHERE value * 10 / 1000.0::DOUBLE <= 0.1) AS le_0_1, count(*) FILTER (WHERE value * 10 / 1000.0::DOUBLE <= 0.5) AS le_0_5,
  count(*) FILTER (WHERE value * 10 / 1000.0::DOUBLE <= 1.0) AS le_1_0
FROM events WHERE event_type <> 'signup' GROUP BY 1, 2, 3"""


def _log(spark, sf):
    return _events(spark, sf).select(
        "ts",
        F.when(F.col("event_type") == "signup", "/metrics").otherwise(F.concat(F.lit("/"), "event_type")).alias("route"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") * 10).alias("duration_ms"),
    )


@register("stream_access_metrics", METRICS_SQL)
def stream_access_metrics(spark, sf):
    bind(spark, sf)
    stream = _as_stream(spark, _log(spark, sf), "access-log")
    rows = _updates(spark, jobs.access_metrics(stream, "ts", FAR_DELAY, "1 hour"), ["window_start", "route", "status"])
    return rows.withColumn("window_start", F.unix_seconds("window_start")).withColumn(
        "duration_ms", F.round("duration_ms", 3)
    )


@register("access_metrics_batch", METRICS_SQL)
def access_metrics_batch(spark, sf):
    bind(spark, sf)
    rows = jobs.access_metrics(_log(spark, sf), "ts", FAR_DELAY, "1 hour")
    return rows.withColumn("window_start", F.unix_seconds("window_start")).withColumn(
        "duration_ms", F.round("duration_ms", 3)
    )


@register(
    "request_ids",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'req-' || lpad(CAST(event_id AS VARCHAR), 8, '0') ELSE substring(sha256(CAST(event_id AS VARCHAR)), 1, 16) END AS request_id,
  CASE WHEN event_type = 'view' THEN '10.0.0.' || user_id ELSE 'peer' END AS address FROM events""",
)
def request_ids(spark, sf):
    incoming = F.expr("CASE WHEN event_type IN ('view', 'click') THEN concat('req-', lpad(CAST(event_id AS STRING), 8, '0')) WHEN event_type = 'error' THEN 'bad id!' END")
    forwarded = F.expr("CASE WHEN event_type = 'view' THEN concat('10.0.0.', user_id, ' , 1.1.1.1') WHEN event_type = 'error' THEN '' END")
    return table(spark, sf, "events").select(
        "event_id",
        jobs.request_id(incoming, F.col("event_id").cast("string")).alias("request_id"),
        jobs.client_address(forwarded, F.lit("peer")).alias("address"),
    )
