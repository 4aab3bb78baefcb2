"""Tokens as rows against the row-local form, encodings as rows, contexts over a corpus."""

import random
from collections import defaultdict

import pytest

from glyphspark.encodings import registry
from glyphspark.encodings.registry import Encoding
from glyphspark.operators import compare, tokens, transcode
from glyphspark.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    letters = [r for e in registry.listed() for r in e.rules] + list(" \n#@中é.,%")
    return [None, "", "K", "¯c&j", "wt†tv"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(40)]


def test_rows_equal_the_row_local_form(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = spark.createDataFrame([("mine", 7, "K", "κ", None), ("mine", 7, "Kw", "ξ", "before-consonant"), ("mine", 7, "", "lost", None), ("mine", 7, "x", None, None)], tokens.RULES)
    rules = tokens.rules_table(spark).unionByName(own)
    got = defaultdict(list)
    for r in tokens.token_rows(docs, rules).collect():
        got[r.doc_id, r.encoding_id].append((r.pos, [r.legacy, r.unicode, r.kind, r.mapped]))
    every = tokens.encodings_of(rules)
    assert [e.id for e in every] == [*(e.id for e in registry.listed()), "mine"] and every[0].post is registry.bijoy_post and every[-1].rules == {"K": ("κ", "none"), "Kw": ("ξ", "before-consonant"), "x": ("", "none")}
    for i, t in enumerate(texts):
        for e in every:
            assert sorted(got[i, e.id]) == list(enumerate(transcode.tokenize(t, e))), (i, e.id)
    counted = {(r.doc_id, r.encoding_id, r.legacy): (r.n, r.unicode, r.kind, r.mapped) for r in tokens.counted_rows(docs, rules).collect()}
    assert counted == {(*k, x[0]): (sum(y[0] == x[0] for _, y in v), *x[1:]) for k, v in got.items() for _, x in v}
    assert spark.sql("SELECT pos, legacy FROM glyph_tokens('KwK', 'mine')").collect() == [(0, "Kw"), (1, "K")]
    plan = tokens.token_rows(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rule_tables_that_are_refused(spark, monkeypatch):
    twice = spark.createDataFrame([("e", 1, "a", "b", None), ("e", 1, "a", "c", None)], tokens.RULES)
    with pytest.raises(ValueError, match="two rules"):
        tokens.encodings_of(twice)
    monkeypatch.setattr(tokens, "MAX_RULES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        tokens.encodings_of(tokens.rules_table(spark))


def test_report_of_a_corpus(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    e = registry.get("bijoy")
    counts, documents, contexts = defaultdict(int), defaultdict(int), defaultdict(list)
    for t in texts:
        for d in transcode.convert(t, "bijoy")["details"]:
            counts[d["sequence"]] += d["count"]
            documents[d["sequence"]] += 1
            contexts[d["sequence"]] += d["contexts"]
    got = {r.sequence: (r.n, r.documents, r.contexts, r.line) for r in tokens.unmapped_report(docs, e).collect()}
    assert got == {s: (counts[s], documents[s], contexts[s][:3], transcode.format_details([{"sequence": s, "count": counts[s], "contexts": contexts[s][:3]}])[0]) for s in counts}
    assert max(documents.values()) > 3 and tokens.unmapped_report(docs.limit(0), e).collect() == []


def test_conversion_without_details(spark, texts):
    for e in registry.listed():
        for t in texts:
            a, b = transcode.convert(t, e.id), transcode.convert(t, e.id, False)
            assert {k: v for k, v in a.items() if k not in ("warnings", "unmapped", "details")} == {k: v for k, v in b.items() if k not in ("warnings", "unmapped", "details")} and b["details"] == []


def test_signs_are_there_to_be_found(spark):
    rows = core.QUERIES["unicode_check_signs"](spark, SF).groupBy("is_nfc", "has_stray_sign").count().collect()
    assert {r.is_nfc for r in rows} == {True, False} == {r.has_stray_sign for r in rows}


def test_pairs_of_texts(spark):
    rows = [("a b", "A c"), (None, ""), ("x", None), ("the The THE", "the"), ("é É", "É é z")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(compare.pair_similarity("a", "b")).collect()]
    assert got == [0.5, 1.0, 0.0, 0.5, pytest.approx(0.8)]


def test_an_encoding_is_shipped_with_the_call(spark):
    e = Encoding("local", "", {"ab": ("X", "none")})
    docs = spark.createDataFrame([(1, "abz")], "doc_id long, text string")
    assert [(r.encoding_id, r.confidence) for r in transcode.detect_scores(docs, [e]).collect()] == [("local", 0.5)]


@pytest.mark.parametrize("name", [e.id for e in registry.listed()])
def test_quick_conversion_equals_the_slow_one(name):
    e, rng = registry.get(name), random.Random(name)
    rules = list(e.rules)
    often = [r for r in rules if e.rules[r][1] != "none" or "\u09cd" in e.rules[r][0]]
    slow = quick = 0
    for n in range(3000):
        pool = rules if n % 3 else rules[:40] + list("  .#\u09be\u09cd\u0995")
        t = "".join(rng.choice(often if rng.random() < (n % 5) / 8 else pool) for _ in range(rng.randrange(1, 25)))
        a = transcode.convert(t, name)
        b = transcode.quick(e).convert(t)
        if b is None:
            slow += 1
            continue
        quick += 1
        d = transcode.quick(e).details(t)
        order = {x: k for k, x in enumerate(a["unmapped"])}
        assert d is None or d == sorted(a["details"], key=lambda x: order[x["sequence"]]), t
        assert b == (a["text"], a["n_tokens"], a["n_unmapped"], a["n_moved"]), t
    assert quick > 300 and (slow > 100 or not e.post)
