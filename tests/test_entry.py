import os
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from glyphspark.encodings import registry
from glyphspark.operators import compare, transcode
from glyphspark.plans import queries as core

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    norm = lambda x: None if pd.isna(x) else str(x) if isinstance(x, bool) else round(float(x), 6) if isinstance(x, (int, float)) else str(x)
    return sorted((tuple(map(norm, r)) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_diff_statistics_hold_together(spark):
    df = entry.queries()["diff_statistics"](spark, SF)
    assert df.where("source_words + target_words - 2 * unchanged_words <> changed_words or percent < 0 or percent > 100").count() == 0


def test_issues_of_every_encoding(spark, tmp_path):
    rng = random.Random(4)
    rows = [(0, None), (1, " \n"), (2, "\u4e2d" * 50), (3, "K" * 4000), (4, "plain")]
    for e in registry.listed():
        rows += [(len(rows) + k, "".join(rng.choice(list(e.rules)) for _ in range(60)) + "@" * (k % 2)) for k in range(20)]
    docs = pd.DataFrame([(i, t, None, None) for i, t in rows], columns=["doc_id", "text", "lang", "source"]).astype({"lang": "string", "source": "string"})
    docs.to_parquet(tmp_path / "documents.parquet")
    want, seen = set(), set()
    for i, t in rows:
        scores = [(transcode.score(t, e)[0], e.id) for e in registry.listed()]
        best = max(scores, key=lambda s: s[0])
        if len("".join((t or "").split())) > (3000, 6000, 25000)[i % 3]:
            want.add((i, "limit_exceeded", "error", "LIMIT_EXCEEDED_ERROR"))
        elif best[0] < 0.6:
            want.add((i, "conversion_failed", "error", "VALIDATION_ERROR"))
        elif transcode.convert(t, best[1])["n_unmapped"]:
            want.add((i, "unmapped_character", "warning", "UNMAPPED_CHARACTER"))
            seen.add(best[1])
    got = [tuple(r)[:4] for r in entry.queries()["conversion_issues"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and seen == {e.id for e in registry.listed()}


def test_paragraphs_of_adjacent_documents(spark, tmp_path):
    rows = [(i, f"one\ntwo {i}\nsame\n" + "x y\n" * (i % 3), "en", f"s{i % 2}") for i in range(45)] + [(45, None, "en", "s1")]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).to_parquet(tmp_path / "documents.parquet")
    got = {(r.a, r.b): (r.source_words, r.target_words, r.equal_tokens, r.removed_tokens, r.added_tokens) for r in entry.queries()["diff_paragraphs"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t, _, _ in rows[:26]:
        r = compare.compare(t.replace("\n", "\n\n"), (rows[i + 20][1] or "").replace("\n", "\n\n"), "paragraph")
        want[i, i + 20] = (r["source_words"], r["target_words"], r["equal_tokens"], r["removed_tokens"], r["added_tokens"])
    assert got == want


def test_issues_of_an_outcome(spark):
    from pyspark.sql import functions as F

    rows = [("CONVERSION_ERROR", [], [], []), ("STORAGE_ERROR", [], [], ["w"]), (None, [f"{k}" for k in range(30)], ["line"], ["said twice"]), (None, [], [], ["one", "two"]), (None, [], [], [])]
    df = spark.createDataFrame(rows, "error string, unmapped array<string>, details array<string>, warnings array<string>")
    got = [[(i.kind, i.severity, i.code, i.message.split("\n")[-1], len(i.samples)) for i in r.i] for r in df.select(transcode.issues(F.struct("*")).alias("i")).collect()]
    assert got == [
        [("conversion_failed", "error", "CONVERSION_ERROR", "CONVERSION_ERROR", 0)], [("unknown", "error", "STORAGE_ERROR", "STORAGE_ERROR", 0), ("validation_warning", "warning", "VALIDATION_WARNING", "w", 0)],
        [("unmapped_character", "warning", "UNMAPPED_CHARACTER", "line", 20)], [("validation_warning", "warning", "VALIDATION_WARNING", "one", 0), ("validation_warning", "warning", "VALIDATION_WARNING", "two", 0)], [],
    ]


def test_stages_and_heads():
    e = registry.get("bijoy")
    got = {s: (n, p) for s, n, p in transcode.stages("wK @", e)}
    assert got["tokenize"] == (3, ["w", "K", "@"]) and got["map"] == (1, ["ি", "ক", "@"]) and got["reorder"] == (1, ["ক", "ি", "@"])
    assert got["assemble"] == (4, ["কি @"]) and got["validate"] == (1, ["@"]) and transcode.stages(" \n", e) == []
    assert transcode.stages("K", e)[-1] == ("validate", 0, ["clean"])
    assert transcode.head("12 Kv KvL x", "12 কা কাখ x") == ("কাখ", "KvL") and transcode.head("12 3", "12 3") == ("12", "12") and transcode.head("", "") == ("", "")
