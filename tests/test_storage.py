"""Stored tables: versions, what a change rewrites, replays, races."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from glyphspark.storage.tables import StoredTable


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable(spark, str(tmp_path / "t"), "k long, name string, n long", ("k",), file_rows=100)


def rows(spark, *given):
    return spark.createDataFrame(list(given), "k long, name string, n long")


def stored(t, version=None):
    return sorted(map(tuple, t.read(version).collect()), key=str)


def test_versions_of_changes(spark, table):
    assert table.version() == 0 and stored(table) == [] and table.lookup(1).collect() == []
    assert table.upsert(rows(spark, (1, "a", 5), (2, "b", 6), (None, "none", 7))) == 1
    assert table.upsert(rows(spark, (2, "B", 60), (None, "null", 70), (3, "c", 8)), keep=("n",)) == 2
    assert stored(table) == sorted([(1, "a", 5), (2, "B", 6), (3, "c", 8), (None, "null", 7)], key=str)
    assert stored(table, 1) == sorted([(1, "a", 5), (2, "b", 6), (None, "none", 7)], key=str)
    assert table.add(rows(spark, (1, "x", 1), (1, "y", 2), (9, "z", 3)).drop("name"), ("n",)) == 3
    assert stored(table) == sorted([(1, None, 8), (2, "B", 6), (3, "c", 8), (9, None, 3), (None, "null", 7)], key=str)
    assert table.delete(rows(spark, (None, "", 0), (3, "", 0), (77, "", 0))) == 4
    assert stored(table) == [(1, None, 8), (2, "B", 6), (9, None, 3)]
    assert table.insert(rows(spark, (1, "no", 0), (4, "yes", 1), (4, "yes", 1))) == 5 and table.insert(rows(spark)) == 5
    assert stored(table) == [(1, None, 8), (2, "B", 6), (4, "yes", 1), (9, None, 3)]
    gone = table.vacuum()
    assert gone and stored(table) == [(1, None, 8), (2, "B", 6), (4, "yes", 1), (9, None, 3)] and table.vacuum() == []


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng, t, want = random.Random(1), StoredTable(spark, str(tmp_path / "t"), "k long, name string, n long", ("k",), file_rows=8), {}
    for step in range(12):
        made = {rng.choice([None, *range(40)]): (f"s{step}", rng.randrange(9)) for _ in range(rng.randrange(0, 9))}
        df = rows(spark, *[(k, *v) for k, v in made.items()])
        if step % 4 == 3:
            t.delete(df)
            want = {k: v for k, v in want.items() if k not in made}
        elif step % 4 == 2:
            t.insert(df)
            want = made | want
        else:
            t.upsert(df)
            want |= made
        assert stored(t) == sorted([(k, *v) for k, v in want.items()], key=str)


def test_only_files_with_touched_keys_are_rewritten(spark, table):
    table.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("name"), F.col("id").alias("n")))
    before = table.state()["files"]
    assert len(before) == 10 and sum(f["rows"] for f in before.values()) == 1000
    ranges = sorted((f["low"], f["high"]) for f in before.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    table.upsert(rows(spark, (5, "five", 0), (2000, "new", 0)))
    after = table.state()["files"]
    assert len(set(before) - set(after)) == 1 and len(set(after) - set(before)) == 1
    table.delete(rows(spark, (1500, "within no range", 0)))
    assert set(table.state()["files"]) == set(after)
    table.insert(rows(spark, (7, "there", 0), (3000, "fresh", 0)))
    assert set(after) < set(table.state()["files"])


def test_lookup_opens_few_files(spark, table):
    table.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("name"), F.col("id").alias("n")))
    df = table.lookup(17, 18)
    assert len(df.inputFiles()) == 1 and sorted(r.k for r in df.collect()) == [17, 18]
    assert "PushedFilters" in df._jdf.queryExecution().executedPlan().toString() and table.lookup(5000).collect() == []


def test_replayed_batches_change_nothing(spark, table):
    for batch, again in ((0, False), (1, False), (1, True), (0, True), (2, False)):
        before = table.version()
        table.add(rows(spark, (1, None, 10)).drop("name"), ("n",), writer="counts", batch=batch)
        assert (table.version() == before) == again
    table.add(rows(spark).drop("name"), ("n",), writer="counts", batch=3)
    assert stored(table) == [(1, None, 30)] and table.state()["batches"] == {"counts": 3}
    assert table.add(rows(spark, (1, None, 1)).drop("name"), ("n",), writer="other", batch=0) and stored(table) == [(1, None, 31)]
    with pytest.raises(ValueError):
        table.add(rows(spark, (1, None, 1)).drop("name"), ("n",), writer="counts")


def test_a_lost_race_is_run_again(spark, table, tmp_path, monkeypatch):
    table.upsert(rows(spark, (1, "a", 1), (2, "b", 1)))
    other = StoredTable(spark, table.root, table.columns, ("k",))
    write = StoredTable._write

    def meanwhile(self, *given):
        made = write(self, *given)
        monkeypatch.setattr(StoredTable, "_write", write)
        other.add(rows(spark, (1, None, 100)).drop("name"), ("n",))
        return made

    monkeypatch.setattr(StoredTable, "_write", meanwhile)
    assert table.add(rows(spark, (1, None, 10), (2, None, 10)).drop("name"), ("n",)) == 3
    assert [(r.k, r.n) for r in table.read().orderBy("k").collect()] == [(1, 111), (2, 11)]
    named = {n.split("/")[1] for v in (1, 2, 3) for n in table.state(v)["files"]}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == named and not list((tmp_path / "t" / "staging").iterdir())


def test_concurrent_writers_lose_no_count(spark, table):
    def work(name):
        for batch in range(3):
            StoredTable(spark, table.root, table.columns, ("k",)).add(rows(spark, (1, None, 1), (len(name), None, 1)).drop("name"), ("n",), writer=name, batch=batch)

    threads = [threading.Thread(target=work, args=("w" * k,)) for k in (2, 3, 4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert [(r.k, r.n) for r in table.read().orderBy("k").collect()] == [(1, 9), (2, 3), (3, 3), (4, 3)] and table.version() == 9


def test_files_are_sized_by_bytes(spark, tmp_path, monkeypatch):
    """Wide rows went to one file, and so through one task, up to a million and a half of them."""
    from glyphspark.storage import tables

    monkeypatch.setattr(tables, "FILE_BYTES", 1 << 16)
    t = StoredTable(spark, str(tmp_path / "wide"), "k long, text string, more array<string>", ("k",))
    made = spark.range(300).select(F.col("id").alias("k"), F.repeat(F.lit("note "), 200).alias("text"), F.array(F.lit("x"), F.lit("y")).alias("more"))
    t.upsert(made)
    files = t.state()["files"]
    assert 4 <= len(files) <= 6 and all(40_000 < f["bytes"] < 120_000 for f in files.values())
    t.upsert(made.where("k < 3").withColumn("text", F.lit("y" * 70_000)))
    assert len(t.state()["files"]) > len(files) and sorted((r.k, r.text[0]) for r in t.read().collect()) == [(k, "y" if k < 3 else "n") for k in range(300)]


def test_one_file_is_not_made_by_one_task(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "one"), "k long, part int", ("k",))
    made = t._write(spark.range(0, 100, 1, 4).select(F.col("id").alias("k"), F.spark_partition_id().alias("part")), 100, 100)
    assert len(made) == 1 and t._frame({"columns": t.columns.jsonValue()}, list(made)).select("part").distinct().count() == 4
