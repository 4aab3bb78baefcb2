"""Operators 11 to 13 against brute force, exact round trips and held-out labels."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphspark.llm import fim, pairrank, repair

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clash(df, *names):
    return df.withColumns({c: F.lit(None).cast("string") for c in names})


# --- 11


def fim_brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def fim_rows():
    rng = random.Random(7)
    odd = [None, "", " ", "\n\t ", "word", "  word", "word  ", "é", "a <P> b", "<M", "x" * 500, " " * 500, "é " * 400, "ü" * 300 + " tail ", "\x0b\x0c\r", "a b  c", "<P", "S> <M"]
    rows = [(i, t) for i, t in enumerate(odd * 4)] + [(None, "one two three"), (-5, "minus five words here now"), (3, None), (3, "same id"), (3, "same id")]
    return rows + [(1000 + i, "".join(rng.choice(["a", "bc", " ", "\n", "é", "longer"]) for _ in range(rng.randrange(300)))) for i in range(150)]


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_fim_equals_brute_force(spark, fim_rows, chunk):
    df = clash(spark.createDataFrame([(*r, "en", "s", 0) for r in fim_rows], SCHEMA), "n", "form", "key", "row").repartition(3)
    rule = fim.Rule(chunk=chunk)
    want = sorted((str(i), *map(str, (n, form, p, m)), text, t or "") for i, t in fim_rows for n, form, p, m, text in [fim_brute(i, t)])
    texts = fim.fim_texts(df, rule)
    got = sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.text, b.text) for r, b in zip(texts.collect(), fim.restored_texts(texts).collect(), strict=True))
    assert got == want
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output_sha256, r.restored_sha256) for r in fim.fim_digests(df, rule).collect())
    assert got == sorted((*w[:5], sha(w[5]), sha(w[6])) for w in want)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_fim_odd_tables(spark, fim_rows):
    assert fim.fim_digests(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(i, "some text of words", None, None, 0) for i in range(300)], SCHEMA)
    assert {r.form for r in fim.fim_texts(df, fim.Rule(rate=100, suffix_first=0)).collect()} == {"psm"}
    assert {r.form for r in fim.fim_texts(df, fim.Rule(rate=0)).collect()} == {"plain"}


def test_fim_sorts_again_without_moving(spark, fim_rows):
    pieces, size = fim.output_pieces(spark.createDataFrame([(*r, "en", "s", 0) for r in fim_rows], SCHEMA), fim.Rule(chunk=9))
    again = pieces.mapPartitions(lambda x: x, preservesPartitioning=True).repartitionAndSortWithinPartitions(size, fim.by_row)
    assert again.toDebugString().decode().count("ShuffledRDD") == 1
    keys = again.glom().map(lambda part: [k for k, _ in part]).collect()
    assert all(part == sorted(part) for part in keys) and len({row for part in keys for row, _ in part}) == len(fim_rows)
    assert sum(len({row for row, _ in part}) for part in keys) == len(fim_rows)


def test_fim_pieces_of_a_long_text():
    text = ("word " * 30 + "x" * 3000 + " é") * 400
    pieces = dict(fim.row_pieces(1, text, fim.Rule(rate=0, chunk=1000)))
    parts = [fim.unpacked(pieces[k]) for k in range(len(pieces) - 1)]
    assert b"".join(parts).decode() == text and max(map(len, parts)) <= 1000 and len(parts) > 1000


# --- 12


def test_pairrank_features_of_pieces():
    rng = random.Random(3)
    text = "\n".join(" ".join(rng.choice(["the", "Of", "a1", "x|y", "ünd", "stop.", "&&&"]) for _ in range(rng.randrange(1, 9))) for _ in range(400)).encode()
    raw = np.frombuffer(text, np.uint8)
    whole = pairrank.features(raw, np.array([0, len(raw)]))
    for most in (50, 333, 5000):
        assert np.allclose(pairrank.long_features(raw, most), whole)
    two = pairrank.features(np.concatenate((raw, raw[:100])), np.array([0, len(raw), len(raw), len(raw) + 100]))
    assert np.allclose(two[0], whole[0]) and np.allclose(two[2], pairrank.features(raw[:100], np.array([0, 100]))[0]) and np.isfinite(two).all()


def measures_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    w3 = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    lines = [x for x in text.split("\n") if x]
    n = max(1, len(text.encode()))
    share = lambda test: np.sqrt(sum(map(test, text)) / n)
    return [np.log1p(len(words)) / 5, sum(len(w.encode()) for w in words) / max(1, len(words)) / 5, share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: " " < c < "\x7f" and not c.isalnum()), share(lambda c: c == "\n"), len(set(words)) / max(1, len(words)), sum(w3.count(w) > 1 for w in w3) / max(1, len(w3)), (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(max((len(w.encode()) for w in words), default=0)) / 5, float(bool(words) and words[-1][-1] in ".!?"), float(not words)]


def test_pairrank_measures_equal_brute_force():
    texts = ["", " \n", "One two. One two. One two.", "a b\na b\nc\n\nd", "ÉTÉ 123 $$$ &&", "word", "x" * 900, "A! B? c"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    got = pairrank.features(raw, at)[:, pairrank.BUCKETS : -1]
    assert np.allclose(got, [measures_brute(t) for t in texts])


def test_pairrank_learns_an_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12))
    true = np.array([2.0, -1, 0.5] + [0] * 9)
    y = (x @ true + rng.normal(size=600) * 0.1 > -1).astype(int)
    w = pairrank.fit_pairs(x, y, 5000)
    assert np.corrcoef(w, true)[0, 1] > 0.95
    s = np.array([1.0, 2, 3, 4, 5, 6])
    assert pairrank.threshold(s, np.array([0, 0, 1, 1, 1, 1]), np.ones(6)) == 2.5
    assert pairrank.threshold(s, np.array([0, 1, 0, 1, 1, 1]), np.array([1, 9, 1, 1, 1, 1.0])) == 1.5
    assert pairrank.threshold(s, np.ones(6, int), np.ones(6)) < 1 and pairrank.threshold(s, np.zeros(6, int), np.ones(6)) > 6


def loss(w, d):
    return np.log1p(np.exp(-d @ w)).mean() + pairrank.RIDGE / 2 * w @ w


def test_pairrank_descends_the_logistic_loss_of_differences():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 5)), np.arange(80) % 2
    x[y == 1, 0] += 1
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, 5)
    w = pairrank.fit_pairs(x, y, 4000, 30)
    best = np.zeros(5)
    for _ in range(4000):
        best += 0.5 * (d * (1 / (1 + np.exp(d @ best)))[:, None]).mean(0) - 0.5 * pairrank.RIDGE * best
    assert loss(w, d) < loss(best, d) + 0.01


def test_pairrank_documents(spark):
    rng = random.Random(6)
    words = ["the", "of", "river", "stone", "walked", "green", "until"]
    good = lambda: " ".join(rng.choice(words) for _ in range(80)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(80)) if rng.random() < 0.5 else "buy now " * 40
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    odd = [(500, None), (501, ""), (None, good()), (502, "x" * 100_000), (503, good()), (503, good()), (504, " \n")]
    docs = clash(spark.createDataFrame([(*r, "en", "s", 0) for r in rows + odd], SCHEMA), "quality", "score", "good", "x", "__id")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(503, None), (4, 1), (None, 1)], "doc_id long, quality int")
    out = pairrank.score_documents(docs, labels).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= pairrank.CUT) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and all(r.predicted == int(r.doc_id % 4 != 0) for r in held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len({r.score for r in out if r.doc_id in (500, 501)}) == 1
    best = {r.doc_id for r in pairrank.keep_best(docs, labels, 0.5).select("doc_id").collect()}
    assert best and all(i is None or i >= 400 or i % 4 for i in best) and abs(len(best) - 200) < 25
    one = labels.where("quality = 1")
    assert {r.score for r in pairrank.score_documents(docs, one).collect()} == {0.5}
    assert pairrank.score_documents(docs.limit(0), labels).collect() == []


# --- 13


def cheapest(rows):
    """(cost, audit, repaired) by best-first search over whole audits. rows: (role, text, fault)."""
    ok = re.compile(r"(s?(ua)+)?")
    state = lambda roles: roles[-1:]
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            assert ok.fullmatch("".join(r[:1] for r, _ in out))
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if len(audit) > 3 * len(rows) + 4 or (i, last, audit) in seen:
            continue
        seen.add((i, last, audit))
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state(last)]
        for role in ("user", "assistant"):
            if role[0] in allowed:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] and role[:1] in allowed:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*out, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in allowed:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, new[0], (*out, (new, text))))


def repair_brute(rows):
    """rows: (turn, role, text) in order."""
    seen, faulty, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        faulty.append((role, text, fault))
    cost, audit, text = cheapest(faulty)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(9)
    out = {None: [(0, "user", "Null id."), (1, "assistant", "Yes.")], 7: [(None, "user", "No turn."), (None, None, None), (4, "assistant", "a"), (9, "user", "No turn.")]}
    for c in range(10, 130):
        turn, rows = rng.randrange(-2, 3), []
        for _ in range(rng.randrange(1, 8)):
            rows.append((turn, rng.choice(["user", "assistant", "system", "tool", None, "", "User"]) if rng.random() < 0.4 else ("user", "assistant")[len(rows) % 2], rng.choice(["Hi.", "Yes!", "cut off", "What? \n", "", " \t", "a.b", None, "Text é."]) if rng.random() < 0.5 else f"Text {turn}."))
            turn += rng.choice([0, 1, 1, 1, 3]) if c % 3 else 1
        out[c] = rows
    return out


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, " " if r[1] is None else r[1], (" " if r[2] is None else r[2])[: repair.HEAD])
    return sorted(rows, key=key)


def test_repair_equals_search(spark, talks):
    rows = [(c, *r) for c, found in talks.items() for r in found]
    random.Random(2).shuffle(rows)
    turns = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), "fault", "key", "marked", "c", "k", "low", "at", "head")
    more = spark.createDataFrame([(999,), (7,), (None,)], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(turns, more).collect()}
    want = {c: repair_brute(in_order(found)) for c, found in talks.items()} | {999: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert got == want
    texts = {}
    for r in sorted(repair.repaired_turns(turns).collect(), key=lambda r: (str(r.conv_id), r.position)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in talks} == {c: w[-1] for c, w in want.items() if c in talks}


def test_repair_spills_and_crosses_batches():
    rng = random.Random(4)
    made = [(k, rng.choice(["user", "assistant", "system"]), f"Text {k} {'.' * (k % 3)}", (0, 0, 0, 3, 1, 2)[rng.randrange(6)]) for k in range(3000)]
    plain, spilled = repair.Conversation(1), repair.Conversation(1)
    spilled.held = repair.Stack(most=500)
    for r in reversed(made):
        plain.turn(*r)
        spilled.turn(*r)
    assert len(spilled.held.blocks) > 100 and not plain.held.blocks
    assert plain.digest() == spilled.digest()
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32()), ("key", pa.binary()), ("marked", pa.bool_())])
    table = pa.Table.from_pylist([dict(zip(schema.names, (c, t, r, x, f, f"{t}{r}{x}".encode(), False), strict=True)) for c in (1, 2) for t, r, x, f in reversed(made)], schema)
    digests = [[c.digest()[1:] for c in repair.conversations(table.to_batches(max_chunksize=size))] for size in (7, 10_000)]
    assert digests[0] == digests[1] and digests[0][0] == digests[0][1]


def test_damage_and_odd_tables(spark):
    rows = [(c, t, "assistant", f"One. Two! {t}?") for c in range(60) for t in range(8)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, repair.damage(turns).collect()))) == sorted(map(str, want))
    assert repair.repair_digests(turns.limit(0)).collect() == [] and repair.repaired_turns(turns.limit(0)).collect() == []
    assert repair.repair_digests(turns.limit(0), turns).count() == 61
