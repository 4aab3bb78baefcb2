"""Streams against their batch forms on any split into batches, with restarts and batches that come again."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glyphspark.plans import activity as act
from glyphspark.plans.stores import Stores, increments, read_or_empty
from glyphspark.storage.tables import StoredTable
from glyphspark.streaming import live

DAY = datetime(2024, 5, 1)


def sent(spark, source, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)


def run(writer, checkpoint):
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def forget_last_commit(checkpoint):
    """As if the process had died after the batch was written and before that was noted."""
    folder = os.path.join(checkpoint, "commits")
    last = str(max(int(n) for n in os.listdir(folder) if n.isdigit()))
    for name in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(folder, name)):
            os.remove(os.path.join(folder, name))


def log_events(seed, n=160):
    rng = random.Random(seed)
    rows = [(rng.choice(["u1", "u2", "u3", None]), f"issue {rng.randrange(12)}", DAY + timedelta(seconds=k // 2), k, rng.choice(["unmapped_character", "unknown"]), rng.choice(["error", "warning"]), [f"s{k}"] if k % 3 else []) for k in range(n)]
    return rows


def as_logs(df):
    return sorted((r.log, r.position, r.issue_key, r.occurrences, r.first_id, r.last_id, r.kind, r.severity, tuple(r.samples)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_live_log_equals_batch_on_any_split(spark, tmp_path, seed):
    rows, source, root, progress = log_events(seed), str(tmp_path / "in"), str(tmp_path / "logs"), str(tmp_path / "progress")
    cuts = sorted(random.Random(seed).sample(range(1, len(rows)), 3))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        part = rows[a:b]
        random.Random(seed).shuffle(part)
        sent(spark, source, part, live.LOG_EVENT)
        stream = spark.readStream.schema(live.LOG_EVENT).parquet(source)
        run(live.log_stream(stream, root, cap=6), progress)
        if k == 1:
            before = live.logs_table(spark, root).version()
            forget_last_commit(progress)
            run(live.log_stream(spark.readStream.schema(live.LOG_EVENT).parquet(source), root, cap=6), progress)
            assert live.logs_table(spark, root).version() == before
    want = as_logs(act.issue_log(spark.createDataFrame(rows, live.LOG_EVENT), 6))
    assert as_logs(live.logs_table(spark, root).read()) == want and {w[0] for w in want} == {"u1", "u2", "u3"} and max(w[1] for w in want) == 5
    assert {r.log for r in live.logs_table(spark, root).lookup("u2").collect()} == {"u2"}


def test_idle_logs_start_anew(spark, tmp_path):
    source, root, progress = str(tmp_path / "in"), str(tmp_path / "logs"), str(tmp_path / "progress")
    for k, hours in enumerate((0, 1, 9, 10, 11)):
        rows = [("other", "x", DAY + timedelta(hours=hours), k, "unknown", "error", [])]
        rows += [("u", "same", DAY + timedelta(hours=hours), 100 + k, "unknown", "error", [])] if hours in (0, 1, 11) else []
        sent(spark, source, rows, live.LOG_EVENT)
        run(live.log_stream(spark.readStream.schema(live.LOG_EVENT).parquet(source), root, idle="2 hours"), progress)
    got = {r.log: (r.occurrences, r.first_id, r.last_id) for r in live.logs_table(spark, root).read().collect()}
    assert got["u"] == (1, 104, 104)


FACT = "kind string, userId string, createdAt string, charCount long, status string, encodingId string, mode string, extractionStatus string, fileType string"


def split(batch):
    return {name: batch.where(F.col("kind") == name) for name in ("conversions", "comparisons", "uploads")}


def facts(seed, n=200):
    rng = random.Random(seed)
    kinds = ["conversions", "comparisons", "uploads"]
    return [(rng.choice(kinds), f"u{rng.randrange(6)}", f"2024-05-0{rng.randrange(1, 5)}T00:00:00Z", rng.randrange(0, 50), rng.choice(["success", "error"]), rng.choice(["bijoy", "sutonny"]), rng.choice(["word", "paragraph"]), rng.choice(["success", "error"]), rng.choice(["pdf", "txt"])) for _ in range(n)]


def test_counter_stream_counts_once(spark, tmp_path):
    rows, source, root, progress = facts(1), str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "progress")
    for k in range(3):
        sent(spark, source, rows[k::3], FACT)
        run(live.counter_stream(spark.readStream.schema(FACT).parquet(source), root, split), progress)
        if k == 1:
            version = Stores(spark, root).counters.version()
            forget_last_commit(progress)
            run(live.counter_stream(spark.readStream.schema(FACT).parquet(source), root, split), progress)
            assert Stores(spark, root).counters.version() == version
    whole = spark.createDataFrame(rows, FACT)
    s = Stores(spark, root)
    want = {tuple(r) for r in increments(**split(whole)).groupBy("name", "scope", "counter").agg(F.sum("n")).collect()}
    assert {tuple(r) for r in s.counters.read().select("name", "scope", "counter", "n").collect()} == want
    daily = act.daily(*[whole.where(F.col("kind") == k).withColumn("created_at", F.to_timestamp(F.substring("createdAt", 1, 10))) for k in ("conversions", "comparisons", "uploads")])
    assert sorted(map(tuple, s.days().select("day", *act.DAILY).collect())) == sorted(map(tuple, daily.select("day", *act.DAILY).collect()))
    mine = [r for r in rows if r[1] == "u3"]
    assert {r.counter: r.n for r in s.of_user("u3").collect()} == {k: v for k, v in {"totalConversions": sum(r[0] == "conversions" for r in mine), "totalComparisons": sum(r[0] == "comparisons" for r in mine), "totalDocuments": sum(r[0] == "uploads" for r in mine), "totalCharsProcessed": sum(r[3] for r in mine if r[0] == "conversions")}.items() if v}
    totals = {(r.dimension, r.value): r.n for r in s.totals().collect()}
    assert totals["totalConversions", "all"] == sum(r[0] == "conversions" for r in rows) and totals["comparisonsByMode", "word"] == sum(r[0] == "comparisons" and r[6] == "word" for r in rows)


def test_first_occurrences_of_streams(spark, tmp_path):
    schema, source = "created_at timestamp, event_id long, made string", str(tmp_path / "in")
    minute = lambda m: DAY + timedelta(minutes=m)
    batches = [
        [(minute(0), 1, "a"), (minute(1), 2, "a"), (minute(2), 3, "b")],
        [(minute(3), 4, "a"), (minute(5), 5, "c")],
        [(minute(60), 6, "d")],
        [(minute(1), 7, "e"), (minute(61), 8, "a"), (minute(61), 9, "d"), (None, 10, None)],
        [(minute(62), 11, "a"), (minute(0), 12, "f")],
    ]
    seen, reports = str(tmp_path / "seen"), str(tmp_path / "reports")
    for rows in batches:
        sent(spark, source, rows, schema)
        stream = lambda: spark.readStream.schema(schema).parquet(source)
        run(live.first_of_window(stream(), F.col("made")).writeStream.format("parquet").option("path", seen).outputMode("append"), str(tmp_path / "p1"))
        run(live.report_stream(stream(), reports, F.col("made")), str(tmp_path / "p2"))
    ids = sorted(r.event_id for r in spark.read.parquet(seen).collect())
    # a (0) and its repeats within the delay; e and f are later than the watermark, no time is not; a comes anew an hour after
    assert [i for i in ids if i not in (1, 2)] == [3, 5, 6, 8, 10] and len(set(ids) & {1, 2}) == 1
    table = StoredTable(spark, reports, "issue_key string", ("issue_key",))
    assert {r.issue_key: r.event_id for r in table.read().collect()} == {"a": 1, "b": 3, "c": 5, "d": 6, "e": 7, None: 10, "f": 12}
    version = table.version()
    forget_last_commit(str(tmp_path / "p2"))
    run(live.report_stream(stream(), reports, F.col("made")), str(tmp_path / "p2"))
    assert table.version() == version


def test_profiles_as_read(spark, tmp_path):
    s = Stores(spark, str(tmp_path / "s"))
    writes = "uid string, email string, displayName string, tier string, at string, seq long"
    bad = s.set_tiers(spark.createDataFrame([("a", "a@x", "A", "expert", "2024-01-02", 2), ("a", "old@x", "Old", "medium", "2024-01-01", 1), ("b", "b@x", "B", "gold", "2024-01-01", 3), ("c", "c@x", None, "easy", "2024-01-01", 4)], writes))
    assert [r.uid for r in bad.collect()] == ["b"]
    s.users.upsert(spark.createDataFrame([("z", None, None, "platinum", "2024-01-01")], s.users.columns))
    got = {r.uid: tuple(r)[1:] for r in s.profiles(spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "uid string")).collect()}
    assert got == {"a": ("a@x", "A", "expert", "2024-01-01", None), "b": (None, None, "easy", None, None), "z": (None, None, None, None, "DATABASE_ERROR")}
    # an invalid stored profile counts as none
    s.set_tiers(spark.createDataFrame([("z", "z@x", "Z", "medium", "2024-03-01", 9), ("a", "new@x", "Ignored", "easy", "2024-03-01", 9)], writes))
    assert {r.uid: (r.email, r.displayName, r.tier, r.createdAt) for r in s.users.read().collect()} == {"a": ("new@x", "A", "easy", "2024-01-01"), "c": ("c@x", None, "easy", "2024-01-01"), "z": ("z@x", "Z", "medium", "2024-03-01")}
    assert {(r.dimension, r.value): r.n for r in s.totals().collect() if r.n} == {("totalUsers", "all"): 3, ("usersByTier", "easy"): 2, ("usersByTier", "medium"): 1}


def test_records_once_and_refused(spark, tmp_path):
    s = Stores(spark, str(tmp_path / "s"))
    columns = "userId string, mode string, similarity double, sourceWordCount long, targetWordCount long, changedWordCount long, createdAt string, extra int"
    rows = spark.createDataFrame([("u", "word", 0.5, 1, 1, 1, "t", 1), ("u", "word", 0.5, 1, 1, 1, "t", 2), ("", "word", 0.5, 1, 1, 1, "t", 3), ("u", "line", 2.0, 1, 1, -1, "t", 4)], columns)
    for _ in range(2):
        assert {r.extra: len(r.issues) for r in s.record(rows, "comparisons").collect()} == {3: 1, 4: 3}
    kept = s.records("comparisons").read()
    assert kept.count() == 1 and "extra" not in kept.columns and len(kept.first().id) == 64


def test_audits_of_settings_and_lists_that_fail(spark):
    p = spark.createDataFrame([("root", True, 5, True, None), ("root", False, 7, None, None)], "actor string, sent_easy boolean, easy long, sent_flags boolean, flags map<string,boolean>")
    assert [tuple(r) for r in act.config_audits(p, ["easy", "flags"]).collect()] == [("root", "config.update", "systemConfig/limits", '{"easy":5,"flags":null}'), ("root", "config.update", "systemConfig/limits", "{}")]
    columns = "userId string, createdAt string, created_at string, event_id long"
    good = lambda: spark.createDataFrame([("u", "t", "t", 1)], columns)
    out = act.history(20, conversions=read_or_empty(good, columns, spark), comparisons=read_or_empty(lambda: spark.read.parquet("/nowhere/at/all"), columns, spark))
    assert [(r["list"], r.event_id) for r in out.collect()] == [("conversions", 1)]


def test_history_of_a_user_opens_few_files(spark, tmp_path):
    s = Stores(spark, str(tmp_path / "s"))
    columns = "userId string, mode string, similarity double, sourceWordCount long, targetWordCount long, changedWordCount long, createdAt string"
    rows = spark.createDataFrame([(f"u{k % 40:02d}", "word", 0.5, k, 1, 1, f"2024-01-{k // 40 + 1:02d}") for k in range(1000)], columns)
    table = s.records("comparisons")
    made = rows.select(F.col("sourceWordCount").cast("string").alias("id"), *rows.columns)
    StoredTable(spark, table.root, made.schema, ("userId", "id"), (F.desc("createdAt"),), file_rows=100).insert(made)
    assert len(table.state()["files"]) == 10
    df = s.history("comparisons", "u07", 5)
    assert [r.createdAt[-2:] for r in df.collect()] == ["25", "24", "23", "22", "21"] and {r.userId for r in df.collect()} == {"u07"}
    assert len(table.lookup("u07").inputFiles()) <= 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(userId,u07)" in plan
    assert s.history("comparisons", "nobody").collect() == []
