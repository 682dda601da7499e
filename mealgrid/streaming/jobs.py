"""Streaming jobs: activity state, deliveries, request counts and access-log metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mealgrid.core.spread import spread
from mealgrid.functions import fixed_values as fixed
from mealgrid.plans.loading import add_deliveries, delivery_outcomes, record_views
from mealgrid.streaming.state import TURNS, VersionedTable, each_batch

WINDOW_SECONDS = 60
STEP_SECONDS = 10
FIXED_WIDTH = (T.LongType, T.IntegerType, T.DoubleType, T.BooleanType, T.TimestampType)


def run_to_end(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append"):
    """Process everything available, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(batch)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# ---------------------------------------------------------------- activity state


def views_step(keep: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """View events (user_id, recipe_id, viewed_at) → latest view per pair, ``keep`` per user."""
    return lambda state, batch: record_views(state, batch, keep).drop("action")


FAVORITES_STATE = "user_id BIGINT, recipe_id BIGINT, adds ARRAY<TIMESTAMP>, removed_at TIMESTAMP"


def favorites_step(late: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Favourite events (user_id, recipe_id, op, ts) → state of each pair: last removal, and the adds after it.

    Times decide, not the order of arrival: a removal that comes late ends only what it is later than, and an add that comes
    late counts only if no later removal was seen. Removals therefore stay in the state. An event may come up to ``late``
    behind the newest one of its pair; of adds before that only the first is kept, so a pair holds the adds of one such span.
    """
    key, span = ["user_id", "recipe_id"], F.expr(f"INTERVAL {late}")
    none = F.array().cast("array<timestamp>")

    def step(state: DataFrame, batch: DataFrame) -> DataFrame:
        news = batch.groupBy(*key).agg(
            F.collect_set(F.when(F.col("op") == "add", F.col("ts"))).alias("new_adds"),
            F.max(F.when(F.col("op") == "remove", F.col("ts"))).alias("new_removed"),
        )
        joined = (
            state.join(news, key, "full")
            .withColumn("removed_at", F.greatest("removed_at", "new_removed"))
            .withColumn("adds", F.array_union(F.coalesce("adds", none), F.coalesce("new_adds", none)))
        )
        alive = F.filter("adds", lambda t: F.col("removed_at").isNull() | (t > F.col("removed_at")))
        joined = joined.withColumn("adds", F.array_sort(alive))
        horizon = F.greatest(F.array_max("adds"), F.col("removed_at")) - span
        settled = F.slice(F.filter("adds", lambda t: t <= horizon), 1, 1)
        kept = F.concat(settled, F.filter("adds", lambda t: t > horizon))
        return joined.select(*key, kept.alias("adds"), "removed_at")

    return step


def favorites(state: DataFrame) -> DataFrame:
    """(user_id, recipe_id, created_at): the pairs that are favourites, since the first add that counts."""
    return state.filter(F.size("adds") > 0).select("user_id", "recipe_id", F.get("adds", F.lit(0)).alias("created_at"))


def delivery_batch(
    fridge: VersionedTable, outcomes: str, product: DataFrame, links: DataFrame
) -> Callable[[DataFrame, int], None]:
    """Deliveries add to the fridge once per batch; what happened to each item is stored under the batch's number in ``outcomes``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        only = fridge.touched(batch)
        state = fridge.read(batch.sparkSession, batch_id, only)
        collect_updates(outcomes)(delivery_outcomes(state, batch, product, links), batch_id)
        fridge.write(add_deliveries(state, batch, product, links), batch_id, only)
        batch.unpersist()

    return run


def keep_state(stream: DataFrame, table: VersionedTable, step, checkpoint: str) -> None:
    """Run a state job to the end of the available data."""
    run_to_end(stream, checkpoint, each_batch(table, step))


# ---------------------------------------------------------------- request counts


REQUEST_STATE = "user_id BIGINT, step BIGINT, requests BIGINT, fresh BOOLEAN"


def request_windows(state: VersionedTable, root: str, ts: str, delay: str, limit: int) -> Callable[[DataFrame, int], None]:
    """Requests per key in sliding 60-second windows, with an over-limit flag: each batch stores the windows that it changed.

    The state holds one row per key and step of ten seconds (``REQUEST_STATE``; ``fresh`` steps are those of the newest batch),
    from which the windows over them are counted. A step is dealt by key and minute, also to the minute before when windows of
    that one reach it, so a key's history is never together and windows are made after the shuffle. Windows that end no later
    than ``delay`` before the newest request of earlier batches are closed: late requests do not count there, and steps that
    only they hold are dropped.
    """
    key, steps = state.key, WINDOW_SECONDS // STEP_SECONDS

    def is_open(last_step: Column, mark: Column | None) -> Column:
        return F.lit(True) if mark is None else F.timestamp_seconds(last_step * STEP_SECONDS + WINDOW_SECONDS) > mark

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        step = F.floor(F.unix_seconds(ts) / STEP_SECONDS).cast("long").alias("step")
        news = batch.where(F.col(ts).isNotNull()).groupBy(key, step).agg(F.count(F.lit(1)).alias("requests"), F.max(F.unix_micros(ts)).alias("newest"))
        news = news.persist()
        earlier = newest_before(spark, f"{root}-newest", batch_id)
        mark = None if earlier is None else F.timestamp_micros(F.lit(earlier)) - F.expr(f"INTERVAL {delay}")
        latest = news.agg(F.greatest(F.max("newest"), F.lit(earlier).cast("long")).alias("newest"))
        latest.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{root}-newest/turn={batch_id % TURNS}")
        only = state.touched(news)
        held = state.read(spark, batch_id, only).select(key, "step", "requests", F.lit(False).alias("fresh"))
        both = held.unionByName(news.select(key, "step", "requests", F.lit(True).alias("fresh")))
        both = both.where(is_open(F.col("step"), mark)).groupBy(key, "step")
        state.write(both.agg(F.sum("requests").alias("requests"), F.bool_or("fresh").alias("fresh")), batch_id, only)
        news.unpersist()

        blocks = F.array_distinct(F.array(*[F.floor((F.col("step") - back) / steps) for back in (0, steps - 1)]))
        current = state.read(spark, batch_id + 1, only).withColumn("block", F.explode(blocks))
        # the windows that start in a block, by place: those from five steps before a step up to it hold that step
        place, within = F.col("step") - F.col("block") * steps, []
        for i in range(steps):
            here = place.between(i, i + steps - 1)
            within.append(F.sum(F.when(here, F.col("requests"))).alias(f"requests{i}"))
            within.append(F.max(here & F.col("fresh")).alias(f"fresh{i}"))
        first = F.col("block") * steps
        cells = [F.when(F.col(f"fresh{i}"), F.struct((first + i).alias("first"), F.col(f"requests{i}").alias("requests"))) for i in range(steps)]
        windows = (
            spread(current, key, "block").groupBy(key, "block").agg(*within)
            .select(key, F.inline(F.array(*cells)))
            .where(F.col("first").isNotNull() & is_open(F.col("first"), mark))
        )
        start = F.timestamp_seconds(F.col("first") * STEP_SECONDS).alias("window_start")
        collect_updates(root)(windows.select(start, key, "requests", (F.col("requests") > limit).alias("over_limit")), batch_id)

    return run


def newest_before(spark: SparkSession, root: str, batch_id: int) -> int | None:
    """The newest time of the batches before one, in microseconds; none before the first."""
    if batch_id == 0:
        return None
    rows = spark.read.schema("newest BIGINT, version BIGINT").parquet(root).where(F.col("version") < batch_id)
    return rows.agg(F.max("newest").alias("t")).first().t


def recent_requests(events: DataFrame, key: str, ts: str, event_id: str) -> DataFrame:
    """Per event: requests of its key in the 60 seconds up to and including it, and the oldest of them.

    An event also enters the next minute as history, and counting runs per (key, minute): a window
    group holds at most two minutes of one key, not its whole history.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    minute = F.floor(F.col("t") / F.lit(WINDOW_SECONDS * 1_000_000))
    width = WINDOW_SECONDS * 1_000_000
    placed = (
        events.select(event_id, key, micros.alias("t"))
        .withColumn("own", minute)
        .withColumn("minute", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    )
    window = Window.partitionBy(key, "minute").orderBy("t").rangeBetween(-(width - 1), 0)
    return (
        placed.withColumn("requests", F.count(F.lit(1)).over(window))
        .withColumn("oldest", F.min("t").over(window))
        .filter(F.col("minute") == F.col("own"))
        .select(event_id, key, "requests", ((F.col("t") - F.col("oldest")) / F.lit(1e6)).alias("oldest_age"))
    )


def waits_of(times: np.ndarray, latest: list[int], limit: int, window: int) -> np.ndarray:
    """Time until each request could be admitted, 0 for those that are; ``times`` ascend, all in microseconds.

    ``latest`` holds the last ``limit`` admissions and is brought up to date. There is room again once the oldest of them is a
    window old, so all requests before that moment are refused together, and the search goes on behind them.
    """
    waits, at = np.zeros(len(times), np.int64), 0
    while at < len(times):
        if len(latest) == limit:
            room = latest.pop(0) + window
            free = int(np.searchsorted(times, room))
            if free > at:
                waits[at:free] = room - times[at:free]
                at = free
            if at == len(times):
                latest.insert(0, room - window)
                break
        latest.append(int(times[at]))
        at += 1
    return waits


def admissions(limit: int, window: float = WINDOW_SECONDS):
    """State function of the limiter: requests of a key wait for the watermark and are decided in order of time.

    The state is the last admissions, at most ``limit`` of them, and the requests that the watermark has not passed, which span
    no more than its delay. A key is forgotten once nothing waits and its last admission is a window old.
    """
    width = int(window * 1_000_000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, times, ids = map(list, state.get) if state.exists else ([], [], [])
        parts = [(np.array(times, np.int64), np.array(ids, np.int64))]
        parts += [(b["t"].to_numpy(np.int64), b["event_id"].to_numpy(np.int64)) for b in batches]
        t, event = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((event, t))
        t, event = t[order], event[order]
        mark = state.getCurrentWatermarkMs() * 1_000
        ready = int(np.searchsorted(t, mark))
        waits = waits_of(t[:ready], latest, limit, width)
        later = t[ready:].tolist()
        if later or (latest and latest[-1] + width > mark):
            state.update((latest, later, event[ready:].tolist()))
            due = later[0] if later else latest[-1] + width
            state.setTimeoutTimestamp(max(due, mark) // 1_000 + 1)
        elif state.exists:
            state.remove()
        after = pd.array(waits / 1e6, dtype="Float64")
        after[waits == 0] = pd.NA
        yield pd.DataFrame({"event_id": event[:ready], "key": [key[0]] * ready, "retry_after": after})

    return run


def admitted_requests(events: DataFrame, limit: int, delay: str, window: float = WINDOW_SECONDS) -> DataFrame:
    """(event_id, key, retry_after): NULL when admitted, else the seconds to wait (streaming).

    ``events`` has event_id, key and ts. A request is decided when the watermark, ``delay`` behind the newest request,
    has passed it; later arrivals are dropped. Keys are users or clients, so a group is what one of them sent.
    """
    timed = events.withWatermark("ts", delay).withColumn("t", F.unix_micros("ts"))
    return timed.groupBy("key").applyInPandasWithState(
        admissions(limit, window),
        "event_id bigint, key string, retry_after double",
        "latest array<bigint>, times array<bigint>, ids array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


# ---------------------------------------------------------------- access log


def access_metrics(log: DataFrame, ts: str, delay: str, width: str) -> DataFrame:
    """Per window, route and status: requests, duration sum and cumulative latency buckets.

    Probes, scrapes, untemplated routes (NULL) and redirects to a slash are not counted.
    """
    route = F.col("route")
    counted = log.filter(route.isNotNull() & ~route.isin(*fixed.SKIPPED_PATHS) & ~route.rlike("^/.+/$"))
    seconds = F.col("duration_ms") / F.lit(1000.0)
    buckets = [
        F.count_if(seconds <= bound).alias("le_" + str(bound).replace(".", "_")) for bound in fixed.LATENCY_BOUNDS
    ]
    return (
        counted.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), "route", "status")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("duration_ms").alias("duration_ms"), *buckets)
        .select(F.col("w.start").alias("window_start"), "route", "status", "requests", "duration_ms",
                *["le_" + str(b).replace(".", "_") for b in fixed.LATENCY_BOUNDS])
    )


def request_id(incoming: Column, fallback: Column) -> Column:
    """The incoming id when it has an accepted form, else 16 hex digits made from ``fallback``."""
    accepted = F.coalesce(incoming.rlike(fixed.REQUEST_ID), F.lit(False))
    return F.when(accepted, incoming).otherwise(F.substring(F.sha2(fallback, 256), 1, 16))


def client_address(forwarded: Column, peer: Column) -> Column:
    """First forwarded address, else the peer."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(peer)


def collect_updates(root: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for update mode: each batch's changed rows under its own number."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return run


def latest_updates(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """The newest row per key of an update-mode result."""
    rows = spread(spark.read.parquet(root), *keys)  # most keys come once, so nothing is gained before the shuffle
    others = [f for f in rows.schema if f.name not in (*keys, "batch")]
    if all(isinstance(f.dataType, FIXED_WIDTH) for f in others):  # such values are aggregated by hash, without a sort
        return rows.groupBy(*keys).agg(*[F.max_by(f.name, "batch").alias(f.name) for f in others])
    newest = F.max_by(F.struct(*[f.name for f in others]), "batch")
    return rows.groupBy(*keys).agg(newest.alias("v")).select(*keys, "v.*")
