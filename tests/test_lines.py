"""Conversion of many texts at once against tokens one by one."""

import random
from collections import Counter

import pytest

from glyphspark.encodings import registry
from glyphspark.encodings.registry import Encoding
from glyphspark.encodings.rules import NONE, PRE, REPH
from glyphspark.operators import glyphs, tokens
from glyphspark.operators import transcode as tc


def odd():
    mixed = {c: (c.upper(), NONE) for c in "abc"} | {"p": ("\u09bf", PRE), "q": ("x", PRE), "r": ("র্", REPH), "h": ("\u09cd", NONE), "j": ("\u09cd\u09af", NONE), "m": ("\u09be", NONE), "n": ("", NONE), "ab": ("ক্", NONE), "  ": ("ল", NONE), "hh": ("\u09cd\u09cd", NONE)}
    joined = mixed | {"q": ("\u09cd", PRE)}
    return [Encoding("mixed", "", mixed), Encoding("posted", "", mixed, registry.bijoy_post), Encoding("swapped", "", mixed, registry.alpha_post), Encoding("joined", "", joined, registry.bijoy_post), Encoding("reversed", "", mixed, lambda t: t[::-1])]


def texts(e, n):
    rng, rules = random.Random(e.id), list(e.rules)
    signs = [r for r in rules if e.rules[r][1] != NONE or "\u09cd" in e.rules[r][0]]
    out = [None, "", " ", " \n"]
    for k in range(n):
        pool = (signs, rules, rules + list("  .#@\u09be\u09cd\u0995😀\u0301"))[k % 3]
        out.append("".join(rng.choice(pool if rng.random() < 0.6 else rules) for _ in range(rng.randrange(1, 40))))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 60])
@pytest.mark.parametrize("e", registry.listed() + odd(), ids=lambda e: e.id)
def test_lines_equal_tokens_one_by_one(monkeypatch, e, piece):
    monkeypatch.setattr(glyphs, "PIECE", piece)
    some, made = texts(e, 1500), tc.rewriter(e)
    seen = 0
    for x in made.lines(some):
        unmapped = x.unmapped(tc.MAX_CONTEXTS)
        for k, t in enumerate(some[x.first : x.last]):
            raw = tc.tokenize(t, e)
            done = e.post(raw) if e.post else raw
            placed = tc.reorder(done)
            mine = slice(*x.at[k : k + 2])
            assert [made.name(i) for i in x.raw[mine]] == [i[0] for i in raw]
            assert [made.name(i) for i in x.mapped[mine]] == [i[0] for i in done] and [made.name(i) for i in x.placed[mine]] == [i[0] for i in placed]
            assert [made.shown(i) for i in x.mapped[mine]] == [i[1] if i[3] else i[0] for i in done], t
            assert x.texts[k] == "".join(i[1] for i in placed), t
            check = tc.validate(placed)
            assert sorted(tc.details_of(x, k, unmapped[k]), key=lambda d: -d["count"]) == check["details"] and [made.name(u[0]) for u in unmapped[k]] == check["unmapped"]
            seen += 1
    assert seen == len(some)


def test_stages_of_a_batch(spark):
    e = registry.get("bijoy")
    some = texts(e, 300)
    docs = spark.createDataFrame(list(enumerate(some)), "i int, t string")
    for r in docs.select("t", tc.trace(docs.t, "bijoy").alias("s"), tc.convert_column(docs.t, "bijoy", True, False).alias("c")).collect():
        assert [(s.stage, s.n, s.preview) for s in r.s] == [tuple(s) for s in tc.stages(r.t, e)]
        blank = not (r.t or "").strip()
        c = tc.convert("", "") | {"error": "FILE_PROCESSING_ERROR"} if blank else tc.convert(r.t, "bijoy")
        assert r.c.asDict() == {k: c[k] for k in r.c.asDict()}


def test_plain_stretches_are_not_looked_at(monkeypatch):
    """A trace took a list for each token of every text; now only what stands near a sign is looked at, once."""
    made, looked = tc.rewriter(Encoding("apart", "", registry.get("bijoy").rules, registry.bijoy_post)), []
    stretch = made._stretch
    monkeypatch.setattr(made, "_stretch", lambda ids: looked.append(len(ids)) or stretch(ids))
    (x,) = made.lines(["KLM" * 10_000 + "wK" + "KLM" * 10_000] * 2)
    assert sum(looked) <= 10 and len(made.known) == 1 and x.texts[0][30_000:30_002] == "কি"


@pytest.mark.parametrize("piece", [1 << 20, 60])
def test_distinct_tokens_of_all_encodings(monkeypatch, piece):
    monkeypatch.setattr(glyphs, "PIECE", piece)
    encodings = registry.listed() + odd()
    some = [t for e in encodings for t in texts(e, 40)]
    got = {(i, k): Counter(dict(found)) for i, k, found in tc.glyphs(encodings).distinct(some)}
    assert got == {(i, k): Counter(e.pattern.findall(t)) for i, t in enumerate(some) if t for k, e in enumerate(encodings)}


def test_a_report_makes_few_contexts(spark, monkeypatch):
    """One row of a task for each sequence, whatever the number of documents; contexts by doc_id, not by arrival."""
    docs = spark.range(500, 0, -1, 2).selectExpr("id AS doc_id", "concat('K@', id) AS text")
    parts = tokens._unmapped_parts(docs, registry.get("bijoy")).collect()
    assert [(r.sequence, len(r.contexts)) for r in parts] == [("@", 3)] * len(parts) and len(parts) <= 2
    (r,) = tokens.unmapped_report(docs, registry.get("bijoy")).collect()
    assert (r.n, r.documents, r.contexts) == (500, 500, ["ক⟦@⟧১", "ক⟦@⟧২", "ক⟦@⟧৩"])


def test_tables_of_encodings_that_callers_bring_do_not_pile_up():
    for n in range(30):
        same = tc.rewriter(Encoding("mine", "", {"a": (str(n // 15), NONE)}))
        assert tc.rewriter(Encoding("mine", "", {"a": (str(n // 15), NONE)})) is same
    assert len(tc._rewriters) <= 8
