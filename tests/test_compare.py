import random
import tracemalloc

import pyarrow as pa

from glyphspark.operators import compare as c


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_is_longest(monkeypatch):
    rng = random.Random(1)
    for cells in (c.CELLS, 20):  # the second round halves tables
        monkeypatch.setattr(c, "CELLS", cells)
        for _ in range(300):
            a, b = ([rng.choice("abc") for _ in range(rng.randrange(14))] for _ in "ab")
            pairs = c.common(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == lcs(a, b)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
            runs = c.changes(a, b, "")
            assert "".join(v for k, v, _ in runs if k != "added") == "".join(a)
            assert "".join(v for k, v, _ in runs if k != "removed") == "".join(b)


def test_segments_rebuild_texts():
    a, b = "one two three.\nfour", "one 2 three!\nfour five"
    s = c.compare(a, b)["segments"]
    assert "".join(x["value"] for x in s if x["kind"] != "added") == a
    assert "".join(x["value"] for x in s if x["kind"] != "removed") == b


def test_short_changes_pair_up():
    r = c.compare("a b c", "a x c")
    assert (r["modifications"], r["unchanged_words"], r["changed_words"]) == (1, 2, 2)
    assert abs(r["similarity"] - 4 / 6) < 1e-9


def test_dice():
    assert c.dice([], []) == 1 and c.dice(["a"], []) == 0 and c.dice(["A", "b"], ["a", "c"]) == 0.5


def test_paragraphs():
    r = c.compare("one\n\ntwo", "one\n\nthree", "paragraph")
    assert [s["kind"] for s in r["segments"]] == ["equal", "removed", "added"] and r["modifications"] == 1


def test_empty():
    assert c.compare("", "")["similarity"] == 1.0 and c.compare(None, "a")["additions"] == 1


def test_long_texts_keep_no_quadratic_trace():
    a, b = [f"a{i}" for i in range(20_000)], [f"b{i}" if i % 3 else f"a{i}" for i in range(20_000)]
    tracemalloc.start()
    pairs = c.common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == 6667 and peak < 130e6


def kinds(r):
    return [(s["kind"], s["value"]) for s in r["segments"]]


def test_bengali_words_stay_whole():
    assert kinds(c.compare("কি", "কী")) == [("removed", "কি"), ("added", "কী")]
    r = c.compare("আমার নাম রহিম।", "তোমার নাম রহিম।")
    assert kinds(r) == [("removed", "আমার"), ("added", "তোমার"), ("equal", " নাম রহিম।")]
    assert r["modifications"] == 1 and r["unchanged_words"] == 2
    r = c.compare("ক্\u200dষ ক", "ক্\u200cষ ক")
    assert kinds(r)[0] == ("removed", "ক্\u200dষ")


def sides(r):
    return tuple("".join(v for k, v in kinds(r) if k != gone) for gone in ("added", "removed"))


def test_equal_and_foreign_texts():
    text = "Ferries leave the harbour at dawn; tickets cost 12 taka."
    r = c.compare(text, text)
    assert kinds(r) == [("equal", text)] and (r["similarity"], r["changed_words"], r["unchanged_words"]) == (1, 0, 10)
    r = c.compare("Salt, pepper and lime", "Nine engines hummed below deck")
    assert r["similarity"] == 0 and r["unchanged_words"] == 0 and r["source_words"] == 4 and r["target_words"] == 5


def test_one_word_more_or_less():
    short, long = "red kites circle", "red kites slowly circle"
    more, less = c.compare(short, long), c.compare(long, short)
    assert (more["additions"], more["removals"], more["modifications"]) == (1, 0, 0)
    assert (less["additions"], less["removals"], less["modifications"]) == (0, 1, 0)
    assert sides(more) == (short, long) and sides(less) == (long, short)
    assert abs(more["similarity"] - 6 / 7) < 1e-9 and more["similarity"] == less["similarity"]


def test_a_word_of_each_side_pairs_up():
    r = c.compare("we sail at noon if the wind holds", "we sail at dusk if the wind holds")
    assert kinds(r) == [("equal", "we sail at "), ("removed", "noon"), ("added", "dusk"), ("equal", " if the wind holds")]
    assert (r["modifications"], r["changed_words"], r["unchanged_words"]) == (1, 2, 7)


def test_long_changes_pair_up_by_shared_words():
    same = "alpha beta gamma delta epsilon zeta eta"
    far = c.compare(f"{same}\n\nkeep", "p1 p2 p3 p4 p5 p6 p7\n\nkeep", "paragraph")
    near = c.compare(f"{same}\n\nkeep", "alpha beta gamma x4 x5 x6 x7\n\nkeep", "paragraph")
    assert (far["modifications"], far["removals"], far["additions"]) == (0, 1, 1)
    assert (near["modifications"], near["removals"], near["additions"]) == (1, 0, 0)  # 3 of 7 shared


def test_similarity_falls_with_the_share_of_changed_words():
    words = [f"w{i}" for i in range(40)]
    seen = [c.compare(" ".join(words), " ".join(w if i >= n else f"v{i}" for i, w in enumerate(words)))["similarity"] for n in range(0, 41, 8)]
    assert seen == sorted(seen, reverse=True) and seen[0] == 1 and seen[-1] == 0


def test_scripts_and_marks_mix():
    a, b = "নদী flows south, নৌকা waits.", "নদী flows north, নৌকা waits!"
    r = c.compare(a, b)
    assert sides(r) == (a, b) and ("removed", "south") in kinds(r) and ("added", "north") in kinds(r)
    assert ("equal", ", নৌকা waits") in kinds(r) and r["unchanged_words"] == 5


def test_paragraphs_come_and_go():
    kept, extra = ["Prologue.", "Epilogue."], "A storm in between."
    one, two = "\n\n".join(kept), "\n\n".join([kept[0], extra, kept[1]])
    assert kinds(c.compare(one, two, "paragraph")) == [("equal", kept[0]), ("added", extra), ("equal", kept[1])]
    assert kinds(c.compare(two, one, "paragraph")) == [("equal", kept[0]), ("removed", extra), ("equal", kept[1])]
    assert kinds(c.compare(one, "\r\n \r\n".join(kept), "paragraph")) == [("equal", one)]


def test_gate_and_badges(spark):
    from pyspark.sql import functions as F

    rows = [("a b", "a c", 10), (" \n", "x", 10), (None, "x", 10), ("x" * 11, "x", 10), ("x" * 10, "x", 10)]
    df = spark.createDataFrame(rows, "a string, b string, n long")
    assert [r[0] for r in df.select(c.gate(F.col("a"), F.col("b"), F.col("n"))).collect()] == [None, "blank", "blank", "over_limit", None]
    r = df.limit(1).select(c.compare_columns(F.col("a"), F.col("b")).alias("r")).select(c.badges(F.col("r")).alias("b")).first().b
    assert tuple(r) == (50, 1, 1)


def test_a_batch_holds_few_segments():
    """All segments of a batch were Python objects at once: about 200 bytes for each of 300 000 here."""
    rng = random.Random(5)
    rows = [[" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(4000)] for _ in "ab"]
    a, b = map(pa.array, rows)
    for segments, most in ((True, 25), (False, 8)):
        tracemalloc.start()
        got = c.compare_batch(a, b, "word", segments)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most << 20
        some = [c.compare(x, y) | ({} if segments else {"segments": []}) for x, y in zip(rows[0][:50], rows[1])]
        assert got[:50].to_pylist() == some
    assert len(c.compare_batch(a[:0], b[:0], "word", True)) == 0
