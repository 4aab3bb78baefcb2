"""Streams that keep stored tables up to date: counters, logs of issues, first occurrences.

Each writes through foreachBatch into a StoredTable under its name and the number of the batch, so a batch that the engine
sends again after a failure changes nothing. State that a stream keeps is bounded by key: rows of a log by its cap, keys of
first occurrences by the watermark.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans import activity as act
from ..plans.stores import Stores, increments
from ..storage.tables import StoredTable

LOG_EVENT = "log string, issue_key string, ts timestamp, event_id long, kind string, severity string, samples array<string>"


def counter_stream(events: DataFrame, root: str, facts: Callable[[DataFrame], dict[str, DataFrame]], name: str = "counters") -> DataStreamWriter:
    """Adds a stream to the counters under root. facts gives the conversions, comparisons and uploads of a batch, by these
    names."""

    def each(batch: DataFrame, number: int) -> None:
        Stores(batch.sparkSession, root).count(increments(**facts(batch)), name, number)

    return events.writeStream.foreachBatch(each)


def live_log(events: DataFrame, cap: int = 200, idle: str | None = None) -> DataFrame:
    """Stream form of issue_log over LOG_EVENT columns, in update mode: each batch gives the whole logs that it changed, rows
    as in LOG. Batches are taken in the order of arrival, events of a batch by ts and event_id; events without a log are left
    out. The state of a log is its rows, cap at most. With idle (such as "2 hours") a log without events for so long, by the
    watermark of ts, starts anew.
    """
    names = [c.split()[0] for c in act.LOG.split(", ")]
    seconds = int(pd.Timedelta(idle).total_seconds()) if idle else 0

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = OrderedDict((k, tuple(r)) for k, r in json.loads(state.get[0])) if state.exists else OrderedDict()
        arrived = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        for k, event, kind, severity, samples in zip(*(arrived[c] for c in ("issue_key", "event_id", "kind", "severity", "samples")), strict=True):
            act.log_event(rows, k, int(event), (kind, severity, None if samples is None else list(samples)), cap)
        state.update((json.dumps(list(rows.items())),))
        if idle:
            state.setTimeoutTimestamp(max(int(arrived["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1000 * seconds)
        yield pd.DataFrame(act.log_rows(key[0], rows), columns=names)

    rows = events.where("log is not null").select("log", "issue_key", "ts", F.col("event_id").cast("long"), "kind", "severity", "samples")
    rows = rows.withWatermark("ts", idle) if idle else rows
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("log").applyInPandasWithState(run, act.LOG, "rows string", "update", timeout)


def logs_table(spark, root: str) -> StoredTable:
    """The logs as their readers see them: all rows of a log are replaced together."""
    return StoredTable(spark, root, act.LOG, ("log",), ("position",))


def log_stream(events: DataFrame, root: str, cap: int = 200, idle: str | None = None, name: str = "logs") -> DataStreamWriter:
    """Keeps the logs under root up to date."""

    def each(batch: DataFrame, number: int) -> None:
        table = logs_table(batch.sparkSession, root)
        if table.holds(name, number):  # the table has it, but the state of the stream is to be brought there again
            batch.write.format("noop").mode("overwrite").save()
        else:
            table.merge(batch, lambda _, new: new, name, number)

    return live_log(events, cap, idle).writeStream.outputMode("update").foreachBatch(each)


def first_of_window(events: DataFrame, key: Column, delay: str = "10 minutes") -> DataFrame:
    """The events of a stream (created_at) whose issue_key none has had within delay of the watermark; later ones than the
    watermark are dropped, those without a time never are. State is the keys of delay."""
    return events.withColumn("issue_key", key).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["issue_key"])


def report_stream(events: DataFrame, root: str, key: Column, name: str = "reports") -> DataStreamWriter:
    """Stores the first event of each issue_key that a stream (created_at, event_id) brings, of those in one batch the
    earliest: exact for all time, the keys are in the table and not in the state of the stream."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("issue_key", key)
        rows = rows.groupBy("issue_key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "issue_key"]), F.struct("created_at", "event_id")).alias("e"))
        rows = rows.select("issue_key", "e.*")
        StoredTable(batch.sparkSession, root, rows.schema, ("issue_key",)).insert(rows, name, number)

    return events.writeStream.foreachBatch(each)
