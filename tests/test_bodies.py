"""Bodies that are malformed, or miss or mistake a field, at any depth."""

import json

from pyspark.sql import functions as F

from glyphspark.plans import bodies
from glyphspark.plans.bodies import Path

PATHS = (
    Path("k", "number", least=1, most=9, whole=True), Path("mode", "string", options=("word", "paragraph")), Path("note", "string", optional=True, nullable=True, most=3), Path("meta", "object", optional=True),
    Path("meta.on", "boolean"), Path("meta.tags", "array", optional=True, most=2), Path("meta.tags[]", "string", least=1), Path("rows", "array", optional=True), Path("rows[].n", "number"),
)
GOOD = {"k": 5, "mode": "word"}


def kind(x):
    return {type(None): "null", bool: "boolean", str: "string", list: "array", dict: "object"}.get(type(x), "number")


def wrong(expected, x):
    return f"Invalid input: expected {expected}, received {x}"


CASES = [
    (GOOD, []),
    (GOOD | {"note": None, "meta": {"on": True, "tags": ["a", "b"]}, "rows": [{"n": 1}, {"n": 2.5}], "extra": [1]}, []),
    ({"mode": "word"}, [f"k: {wrong('number', 'undefined')}"]),
    ({"k": None, "mode": "word"}, [f"k: {wrong('number', 'null')}"]),
    ({"k": "5", "mode": 5}, [f"k: {wrong('number', 'string')}", f"mode: {wrong('string', 'number')}"]),
    ({"k": 0, "mode": "line"}, ["k: Too small: expected number to be >=1", 'mode: Invalid option: expected one of "word"|"paragraph"']),
    ({"k": 10, "mode": "word", "note": "long"}, ["k: Too big: expected number to be <=9", "note: Too big: expected string to have <=3 characters"]),
    ({"k": 2.5, "mode": "word"}, [f"k: {wrong('int', 'number')}"]),
    (GOOD | {"meta": []}, [f"meta: {wrong('object', 'array')}"]),
    (GOOD | {"meta": None}, [f"meta: {wrong('object', 'null')}"]),
    (GOOD | {"meta": {}}, [f"meta.on: {wrong('boolean', 'undefined')}"]),
    (GOOD | {"meta": {"on": 1, "tags": "a"}}, [f"meta.on: {wrong('boolean', 'number')}", f"meta.tags: {wrong('array', 'string')}"]),
    (GOOD | {"meta": {"on": False, "tags": ["", None, {}]}}, ["meta.tags: Too big: expected array to have <=2 items", "meta.tags.0: Too small: expected string to have >=1 characters", f"meta.tags.1: {wrong('string', 'null')}", f"meta.tags.2: {wrong('string', 'object')}"]),
    (GOOD | {"rows": [{"n": 1}, {}, 7, {"n": "x"}]}, [f"rows.1.n: {wrong('number', 'undefined')}", f"rows.3.n: {wrong('number', 'string')}"]),
    ([1], [f"body: {wrong('object', 'array')}"]),
]


def test_cases_told_apart(spark):
    rows = [(k, json.dumps(body)) for k, (body, _) in enumerate(CASES)] + [(100, '{"k": 5, "mo'), (101, ""), (102, None), (103, "null"), (104, "not json")]
    df = spark.createDataFrame(rows, "id long, body string")
    got = {r.id: r.i for r in df.select("id", bodies.issues(F.col("body"), PATHS).alias("i")).collect()}
    for k, (body, want) in enumerate(CASES):
        assert got[k] == want, body
    assert got[100] == got[101] == got[102] == got[104] == [bodies.MALFORMED] and got[103] == [f"body: {wrong('object', 'null')}"]


def test_fields_of_bodies(spark):
    df = spark.createDataFrame([('{"k": 7, "meta": {"on": true, "tags": ["x", null]}}',), ('{"k": "seven"}',), ("{",)], "body string")
    rows = bodies.parsed(df, "body", {"k": ("k", "long"), "on": ("meta.on", "boolean"), "tags": ("meta.tags", "array<string>")}, PATHS[:1]).collect()
    assert [(r.k, r.on, r.tags, len(r.issues)) for r in rows] == [(7, True, ["x", None], 0), (None, None, None, 1), (None, None, None, 1)]
