"""Counts in one pass against tokens one by one."""

import random
from collections import Counter

import pytest

from glyphspark.encodings import registry
from glyphspark.encodings.registry import Encoding
from glyphspark.encodings.rules import NONE, PRE
from glyphspark.operators import glyphs, transcode


def odd():
    plain = {c: (c.upper(), NONE) for c in "abcdef"}
    overlapping = plain | {"ab": ("1", NONE), "abc": ("2", PRE), "bcd": ("3", NONE), "cdcd": ("4", NONE), "dcdcd": ("5", NONE), "  ": ("6", NONE), " é": ("7", NONE), "éa": ("8", NONE)}
    long = plain | {"abcdefabcdefabcdefabcdefabcdef": ("9", NONE), "fa": ("x", NONE)}
    return [Encoding("overlapping", "", overlapping), Encoding("long", "", long), Encoding("none", "", {})]


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_counts_equal_tokens(monkeypatch, piece):
    monkeypatch.setattr(glyphs, "PIECE", piece)
    rng = random.Random(3)
    encodings = registry.listed() + odd()
    letters = [c for e in encodings for r in e.rules for c in r] + list(" \n é中😀.,%@#")
    rules = [r for e in encodings for r in e.rules]
    texts = [None, "", " ", " ", "ab", "abcd", "bcdcdcd", "a  b   c", " é éa", "abcdef" * 11, "é"]
    texts += ["".join(rng.choice(letters if rng.random() < 0.5 else rules) for _ in range(rng.randrange(120))) for _ in range(150)]
    tables = transcode.glyphs(encodings)
    confidence, legacy = tables.scores(texts)
    totals = tables.counts(texts, False)
    for k, e in enumerate(encodings):
        assert [(c, x) for c, x in zip(confidence[k], legacy[k])] == [pytest.approx(transcode.score(t, e)) for t in texts]
        for t, n in zip(texts, totals[k].tolist()):
            found = Counter(e.pattern.findall(t or ""))
            good = sum(m for x, m in found.items() if transcode.mapped(x, e))
            assert n[:2] == [found.total(), good], (e.id, t)
        got = tables.unmapped(texts, k).to_pylist()
        assert [dict(x) for x in got] == [{x: n for x, n in Counter(e.pattern.findall(t or "")).items() if not transcode.mapped(x, e)} for t in texts]


def test_detection_of_encodings_that_a_caller_brings(spark):
    docs = spark.createDataFrame([(1, "abcdcdcd"), (2, None), (3, "Avgvi")], "doc_id long, text string")
    every = odd()
    got = {(r.doc_id, r.encoding_id): (r.ord, r.confidence, r.legacy_coverage) for r in transcode.detect_scores(docs, every).collect()}
    for i, t in ((1, "abcdcdcd"), (2, None), (3, "Avgvi")):
        for k, e in enumerate(every):
            assert got[i, e.id] == (k, *transcode.score(t, e))
