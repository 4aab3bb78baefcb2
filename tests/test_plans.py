import datetime as dt
import io
import random
import zipfile

from pyspark.sql import functions as F

from glyphspark.functions import text as tx
from glyphspark.plans import activity as act
from glyphspark.plans import schemas
from glyphspark.sources import documents as src
from glyphspark.streaming import limits


def test_text_measures(spark):
    df = spark.createDataFrame([("a b ﻿c\n\n d\r\n\r\ne",), ("",), (None,), ("\U0001f600 x",)], "t string")
    rows = df.select(tx.non_ws_chars(F.col("t")), tx.word_count(F.col("t")), F.size(tx.paragraphs(F.coalesce("t", F.lit(""))))).collect()
    assert [tuple(r) for r in rows] == [(5, 5, 3), (0, 0, 0), (0, 0, 0), (2, 2, 1)]


def test_usage_boundaries(spark):
    df = spark.createDataFrame([(3000,), (3001,), (2551,)], "n long")
    rows = df.select(act.check_usage(F.col("n"), act.tier_limit(F.lit("easy"), F.lit(None)), F.lit("easy")).alias("u")).select("u.*").collect()
    assert [(r.within_limit, r.remaining, r.band) for r in rows] == [(True, 0, "warning"), (False, 0, "danger"), (True, 449, "warning")]
    assert rows[1].message == "This input has 3,001 characters, which exceeds the easy tier limit of 3,000. Reduce the input or use a higher tier." and rows[0].message is None


def test_rate_limit(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 9, 10, 11])] + [("b", t, 9)]
    out = limits.rate_limit(spark.createDataFrame(rows, "key string, ts timestamp, event_id long"), 2, 10.0).orderBy("event_id").collect()
    assert [r.allowed for r in out] == [True, True, False, False, True, True, True]
    assert [r.retry_after for r in out][2:4] == [8, 1]


def test_limits_for_callers_without_account(spark):
    callers = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "caller_id long, uid long")
    users = spark.createDataFrame([(5, "medium")], "uid long, tier string")
    own = spark.createDataFrame([(6, 10)], "uid long, max long")
    wide = spark.createDataFrame([("medium", 7), ("easy", 8)], "tier string, max long")
    got = {r.caller_id: (r.tier, r.max) for r in act.resolve_limits(callers, users, own, wide).collect()}
    assert got == {1: ("medium", 7), 2: ("easy", 3000), 3: ("easy", 10)}


def test_odd_archives_give_rows(spark):
    """Whatever is wrong with an archive names an error; a document that unpacks to too much is refused."""
    def zipped(name, body, spoil=None):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, body)
        data = bytearray(out.getvalue())
        if spoil:
            at = 30 + len(name) + 5
            data[at : at + 20] = spoil * 20
        return bytes(data)

    ok = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body/></w:document>'
    locked = bytearray(zipped("word/document.xml", ok * 3))
    for mark in (b"PK\x03\x04", b"PK\x01\x02"):
        at = locked.index(mark) + (6 if mark[2] == 3 else 8)
        locked[at] |= 1  # encrypted
    rows = [(0, zipped("other.xml", "x")), (1, zipped("word/document.xml", "<a")), (2, zipped("word/document.xml", ok * 50, b"\xff")), (3, bytes(locked)), (4, zipped("word/document.xml", " " * (src.MAX_UNPACKED + 1)))]
    df = spark.createDataFrame([(str(i), len(c), c, "a.docx", None) for i, c in rows], "path string, length long, content binary, file_name string, mime string")
    assert {r.path: r.error for r in src.extract(df).collect()} == {"0": "corrupted", "1": "corrupted", "2": "corrupted", "3": "corrupted", "4": "too_large"}


def test_extraction(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>hi</w:t></w:r></w:p></w:body></w:document>')
    rows = [(1, b"\xef\xbb\xbfabc", "a.txt"), (2, b"", "a.txt"), (3, b"x" * 50, "b.txt"), (4, b"x", "c.exe"), (5, data.getvalue(), "d.DOCX"), (6, b"no zip", "e.docx"), (7, b" \n", "f.txt"), (8, b"%PDF", "g.pdf")]
    df = spark.createDataFrame([(str(i), len(c), c, n, None) for i, c, n in rows], "path string, length long, content binary, file_name string, mime string")
    got = {int(r.path): (r.text, r.error) for r in src.extract(df, max_bytes=1000).collect()}
    assert got[1] == ("abc", None) and got[2][1] == "empty" and got[4][1] == "unsupported" and got[5] == ("hi\n\n", None)
    assert got[6][1] == "corrupted" and got[7] == (None, "empty") and got[8][1] == "extraction_failed"
    assert {r.path: r.error for r in src.extract(df, max_bytes=20).collect()}["3"] == "too_large"


def test_issue_merge_and_daily(spark):
    t = dt.datetime(2024, 1, 1, 23)
    df = spark.createDataFrame([(i, t + dt.timedelta(hours=i), "error" if i % 2 else "view", i % 3) for i in range(6)], "event_id long, created_at timestamp, kind string, user_id long")
    merged = act.merge_issues(df, act.issue_key("kind")).collect()
    assert {r.issue_key: r.occurrences for r in merged} == {"error": 3, "view": 3}
    conversions = df.selectExpr("created_at", "10 as charCount", "if(kind = 'error', 'error', 'success') as status")
    uploads = df.where("event_id > 3").selectExpr("created_at", "'success' as extractionStatus")
    rollup = act.daily(conversions, df.select("created_at").limit(0), uploads)
    assert {r.day: tuple(r)[1:] for r in rollup.collect()} == {"2024-01-01": (1, 0, 0, 10, 0, 0), "2024-01-02": (5, 0, 2, 50, 3, 0)}
    assert [(r.day, r.position) for r in act.last_days(rollup, 1).collect()] == [("2024-01-02", 1)]
    assert act.last_days(rollup, strict=True).count() == 0  # no day has comparisons


def test_keys_do_not_run_together(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a\\", "|b"), ("a\\|", "b"), (None, ""), ("", None)]
    keys = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(act.issue_key("x", "y")).collect()]
    assert len(set(keys[:4])) == 4 and keys[4] == keys[5] == "|"


def test_log_keeps_the_newest(spark):
    """The log as one reader keeps it, event by event."""
    rng = random.Random(5)
    t = dt.datetime(2024, 1, 1)
    rows = [(log, f"k{rng.randrange(12)}", t + dt.timedelta(seconds=i), i, "unmapped_character" if i % 2 else "unknown", "error" if i % 3 else "warning", [f"s{i % 4}", f"t{i % 3}"]) for i in range(300) for log in ("a", "b")]
    want = []
    for log in ("a", "b"):
        held = []
        for r in [r for r in rows if r[0] == log]:
            old = next((h for h in held if h[0] == r[1]), None)
            if old:
                held.remove(old)
                held.insert(0, (old[0], old[1] + 1, old[2], r[3], *old[4:]))
            else:
                held = [(r[1], 1, r[3], r[3], *r[4:]), *held][:5]
        want += [(log, i, *h) for i, h in enumerate(held)]
    df = spark.createDataFrame(rows, "log string, issue_key string, ts timestamp, event_id long, kind string, severity string, samples array<string>")
    log = act.issue_log(df, 5)
    assert sorted(map(tuple, log.collect())) == sorted(want)
    got = {r.log: (r.errors, r.warnings, r.samples) for r in act.log_summary(log).collect()}
    for name in ("a", "b"):
        mine = [w for w in want if w[0] == name]
        samples = list(dict.fromkeys(s for w in mine if w[6] == "unmapped_character" for s in w[8]))
        assert got[name] == (sum(w[7] == "error" for w in mine), sum(w[7] != "error" for w in mine), samples)
    assert act.issue_log(df.limit(0)).count() == 0


def test_every_schema_takes_its_own_rows(spark):
    good = {"string": "x", "number": 1, "boolean": True, "array": ["x"], "record": {"k": "v"}}
    types = {"string": "string", "number": "long", "boolean": "boolean", "array": "array<string>", "record": "map<string,string>"}
    assert len(schemas.COLLECTIONS) == 11
    for name, fields in schemas.COLLECTIONS.items():
        row = {f.name: f.options[0] if f.options else good[f.kind] for f in fields}
        ddl = ", ".join(f"{f.name} {types[f.kind]}" for f in fields)
        bad, want = [], []
        for f in fields:
            bad.append(row | {f.name: None})
            want.append(0 if f.nullable else 1)
            for limit, value in ((f.least, None if f.least is None else f.least - 1), (f.above, f.above), (f.most, None if f.most is None else f.most + 1)):
                if limit is not None and not f.options:
                    bad.append(row | {f.name: "" if f.kind == "string" else value})
                    want.append(1)
            if f.options:
                bad.append(row | {f.name: "nothing known"})
                want.append(1)
        df = spark.createDataFrame([tuple(r[f.name] for f in fields) for r in [row, *bad]], ddl)
        assert [r[0] for r in df.select(F.size(schemas.issues(name))).collect()] == [0, *want], name


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u", 5, "x", "a"), ("", 0, None, "a")], "uid string, maxNonWhitespaceChars long, updatedAt string, updatedBy string")
    for _ in range(2):
        refused = schemas.append_valid(df, "usageOverrides", str(tmp_path / "o")).collect()
    assert [r.issues for r in refused] == [["uid: Too small: expected string to have >=1 characters", "maxNonWhitespaceChars: Too small: expected number to be >0", "updatedAt: Invalid input: expected string, received null"]]
    stored = spark.read.parquet(str(tmp_path / "o"))
    assert stored.count() == 2 and stored.select("id").distinct().count() == 2
    assert schemas.delete_by_key(stored, df.limit(1), "uid").count() == 0
    src.write_text(spark.createDataFrame([("é x",), (None,)], "text string").coalesce(1), str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["", "é x"]


def test_bodies(spark):
    df = spark.createDataFrame([(1, '{"a": 5}'), (2, "{"), (3, None), (4, '{"a": 50}')], "id long, body string")
    got = {r.id: (r.a, r.issues) for r in schemas.parse_bodies(df, "body", "a long", (schemas.Field("a", "number", most=9),)).collect()}
    missing = ["a: Invalid input: expected number, received null"]
    assert got == {1: (5, []), 2: (None, missing), 3: (None, missing), 4: (50, ["a: Too big: expected number to be <=9"])}


def test_filters_and_pages(spark):
    assert act.known_filter("bogus", schemas.KINDS) is None and act.known_filter("unknown", schemas.KINDS) == "unknown" and act.known_filter(None, schemas.KINDS) is None
    df = spark.range(120)
    assert [r.id for r in act.page(df, "id", 99).collect()] == list(range(100, 120)) and act.page(df, "id").count() == 50 and act.page(df, "id", 119).count() == 0


def test_clamps(spark):
    df = spark.createDataFrame([("m" * 600, ["s" * 70] * 30, None), ("m", None, 4)], "message string, samples array<string>, n long")
    a, b = df.select(*act.clamp_error(F.col("message"), F.col("samples"), F.col("n"))).collect()
    assert len(a.message) == 500 and len(a.samples) == 20 and set(map(len, a.samples)) == {60} and a.occurrences == 1 and b.occurrences == 4


def test_streams_give_rows(spark, tmp_path):
    """A stream of files: limits by key as in batch, and closed days."""
    t = dt.datetime(2024, 1, 1)
    seconds = [0, 1, 2, 9, 10, 11, 20 * 86400]
    df = spark.createDataFrame([("a", t + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)], "key string, ts timestamp, event_id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(rows, name, mode):
        q = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = {r.event_id: (r.allowed, r.retry_after) for r in run(limits.rate_limit_stream(stream, 2, 10), "limited", "append")}
    want = {r.event_id: (r.allowed, r.retry_after) for r in limits.rate_limit(df, 2, 10.0).collect()}
    assert got == want
    days = run(limits.daily_stream(stream.select(F.col("ts").alias("created_at"), F.lit("view").alias("kind")), {"view": "views"}), "days", "append")
    assert [(r.day, r.views) for r in days] == [("2024-01-01", 6)]


def test_streams_start(spark):
    rate = spark.readStream.format("rate").load().select(F.col("value").cast("string").alias("key"), F.col("timestamp").alias("ts"), F.col("value").alias("event_id"))
    assert limits.rate_limit_stream(rate, 2, 60).isStreaming
    days = rate.select(F.col("ts").alias("created_at"), F.lit("view").alias("kind"))
    assert limits.daily_stream(days, {"view": "views"}).columns == ["day", "views"]


def test_notes_of_archives(spark):
    def archive(body):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:o="urn:other"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    plain = archive("<w:p><w:pPr><w:odd/></w:pPr><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tblPr/><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>")
    odd = archive("<w:p><w:r><w:drawing><w:inner/></w:drawing><w:t>text</w:t></w:r></w:p><o:shape><o:x/></o:shape><w:p><w:r><w:drawing/><w:sym/></w:r></w:p><w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>")
    blank = archive("<w:p><w:r><w:pict/></w:r></w:p>")
    rows = [(str(k), len(c), c, "a.docx", None) for k, c in enumerate((plain, odd, blank, b"no zip"))] + [("9", 3, b"txt", "a.txt", None)]
    got = {r.path: (r.text, r.error, r.notes) for r in src.extract(spark.createDataFrame(rows, "path string, length long, content binary, file_name string, mime string")).collect()}
    said = lambda *names: [f"An unrecognised element was ignored: {x}" for x in names]
    assert got == {"0": ("one\ttwo\n\ncell\n\n", None, None), "1": ("text\n\n\n\n\n\n", None, said("w:drawing", "shape", "w:sym")), "2": (None, "empty", None), "3": (None, "corrupted", None), "9": ("txt", None, None)}
