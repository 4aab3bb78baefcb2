"""Rate limits as keyed state, and the daily rollup of a stream."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "key string, ts timestamp, event_id long, allowed boolean, retry_after long"


def decide(window: tuple[float, int] | None, now: float, limit: int, seconds: float) -> tuple[tuple[float, int], bool, int]:
    """Fixed windows that start at the key's first accepted event: (state, allowed, seconds to wait)."""
    if window is None or now - window[0] >= seconds:
        return (now, 1), True, 0
    if window[1] >= limit:
        return window, False, max(1, math.ceil(window[0] + seconds - now))
    return (window[0], window[1] + 1), True, 0


def rate_limit(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Batch form over (key, ts, event_id). Keys stream through tasks in order, so a hot key costs time but no memory."""

    def run(batches):
        key, window = None, None
        for b in batches:
            allowed, wait = [], []
            for k, t in zip(b["key"], b["ts"].astype("int64") / 1e9 if b["ts"].dtype == "datetime64[ns]" else b["ts"].map(lambda x: x.timestamp()), strict=True):
                if k != key:
                    key, window = k, None
                window, ok, more = decide(window, float(t), limit, seconds)
                allowed.append(ok)
                wait.append(more)
            yield b.assign(allowed=allowed, retry_after=wait)

    rows = events.select(F.col("key").cast("string"), "ts", F.col("event_id").cast("long")).repartition(F.xxhash64("key")).sortWithinPartitions("key", "ts", "event_id")
    return rows.mapInPandas(run, OUT)


def rate_limit_stream(events: DataFrame, limit: int, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Stream form: state of a key is its window, dropped once the watermark passes the window's end."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        window = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed, wait = [], []
        for t in rows["ts"]:
            window, ok, more = decide(window, t.timestamp(), limit, seconds)
            allowed.append(ok)
            wait.append(more)
        state.update(window)
        state.setTimeoutTimestamp(max(int((window[0] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=allowed, retry_after=wait)[["key", "ts", "event_id", "allowed", "retry_after"]]

    rows = events.select(F.col("key").cast("string"), "ts", F.col("event_id").cast("long")).withWatermark("ts", delay)
    return rows.groupBy("key").applyInPandasWithState(run, OUT, "start double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def daily_stream(events: DataFrame, kinds: dict[str, str], delay: str = "1 day") -> DataFrame:
    """The daily rollup of a stream of (created_at, kind), a day emitted once the watermark passes it."""
    counts = [F.count_if(F.col("kind") == k).alias(name) for k, name in kinds.items()]
    rows = events.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day")).agg(*counts)
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *kinds.values())
