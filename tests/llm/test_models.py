"""Verdicts of operators 1, 2 and 7 recomputed in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphspark.llm import langid, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# --- 1


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def cube(x, k):
    return ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))


def battery(token):
    """(stratum, p-value of the text hypothesis, least p-value of the three tests)."""
    body = re.sub("=+$", "", token)
    code = next((name for name, (pattern, _) in secrets.ENCODINGS.items() if re.search(pattern, body)), "base64")
    body = body or "A"
    alphabet = secrets.ENCODINGS[code][1]
    text = body.lower() if code in secrets.FOLDED else body
    n, a = len(text), len(alphabet) - (2 if code == "base64" else 0)
    chi = sum(c * c for c in Counter(text).values()) * a / n - n
    z = cube(chi + 1e-9, a - 1)
    p_chi = min(1, 2 * min(tail(z), 1 - tail(z)))
    place = [alphabet.index(c) if c in alphabet else 0 for c in text]
    bits = [2 * i >= len(alphabet) for i in place]
    runs, ones = 1 + sum(x != y for x, y in zip(bits, bits[1:])), sum(bits)
    mean = 2 * ones * (n - ones) / n + 1
    spread = max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9)
    p_runs = 2 * tail(abs(runs - mean) / math.sqrt(spread))
    level = [16 * i // len(alphabet) for i in place]
    m = sum(level) / n
    var = max(sum(v * v for v in level) - n * m * m, 1e-9)
    r = (sum(x * y for x, y in zip(level, level[1:])) - (n - 1) * m * m) / var
    p_serial = 2 * tail(abs(r) * math.sqrt(n))
    k = a - 1
    lam = n * (a * max(secrets.TEXT_IC, 2 / a) - 1)
    c, h = (k + 2 * lam) / (k + lam), (k + lam) ** 2 / (k + 2 * lam)
    p_text = tail(-cube((chi + 1e-9) / c, h))
    return f"{code}-{sum(n >= b for b in secrets.BANDS)}", p_text, min(p_chi, p_runs, p_serial)


@pytest.fixture(scope="module")
def tokens():
    rng = random.Random(12)
    alphabets = [a for _, a in secrets.ENCODINGS.values()] + ["0123456789abcdef", "ab", "abcdefghij"]
    made = ["".join(rng.choice(a) for _ in range(rng.choice([20, 24, 27, 28, 33, 40, 64, 90]))) for a in alphabets for _ in range(25)]
    return made + ["a" * 30, "ab" * 20, "0123456789" * 3, "the-quick-brown-fox-jumps-over", "A" * 19 + "=", "=" * 25, "abcdefghijklmnopqrstuvwxyz", "word_and_word_and_word_again"]


def test_battery_equals_plain_python(spark, tokens):
    rows = spark.createDataFrame(list(enumerate(tokens)), "id long, t string").select("id", secrets.battery(F.col("t")).alias("b")).select("id", "b.*").collect()
    told = 0
    for r in rows:
        stratum, p_text, least = battery(tokens[r.id])
        assert r.stratum == stratum, tokens[r.id]
        assert abs(r.bin - math.floor(-10 * math.log10(max(p_text, 1e-300)))) <= 1, tokens[r.id]
        if abs(3 * least / secrets.BATTERY - 1) > 0.02:
            assert r.random == (3 * least >= secrets.BATTERY), tokens[r.id]
            told += 1
    assert told > len(tokens) * 0.98 and len({r.random for r in rows}) == 2


def test_false_discovery_control_equals_plain_python(spark):
    rng = random.Random(3)
    found = [(s, int(rng.expovariate(1 / scale))) for s, scale in (("a-0", 30), ("b-1", 4), ("c-2", 0.5), ("d-0", 15)) for _ in range(rng.randrange(50, 200))]
    want = {}
    for s in {s for s, _ in found}:
        mine = sorted((b for x, b in found if x == s), reverse=True)
        passed = [b for k, b in enumerate(mine) if 10 ** (-b / 10) <= secrets.Q * max(i for i, y in enumerate(mine, 1) if y == b) / len(mine)]
        if passed:
            want[s] = min(passed)
    got = secrets._bh(spark.createDataFrame(found, "stratum string, bin int"))
    assert got == want and 0 < len(want) < 4


def test_random_spans_equal_plain_python(spark, tokens):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice([t, "plain words here", "é", "token=abcdefgh1234"]) for _ in range(3))) for k, t in enumerate(tokens)]
    pattern = re.compile(secrets.CANDIDATE)
    runs = []
    for k, t in docs:
        base = [(m.start(), m.end()) for p, g, n in ((x[1], x[2], x[3]) for x in secrets.BASE) for m in re.finditer(p, t) if len(m[g]) >= n]
        runs += [(k, m.start(), m.end(), *battery(m[0])) for m in pattern.finditer(t) if not any(a < m.end() and m.start() < b for a, b in base)]
    strata = {r[3] for r in runs}
    limit = {}
    for s in strata:
        bins = sorted((math.floor(-10 * math.log10(max(r[4], 1e-300))) for r in runs if r[3] == s), reverse=True)
        good = [b for b in bins if 10 ** (-b / 10) * len(bins) <= secrets.Q * sum(x >= b for x in bins)]
        limit[s] = min(good, default=10**9)
    want = {(k, a, b) for k, a, b, s, p, least in runs if 3 * least >= secrets.BATTERY and math.floor(-10 * math.log10(max(p, 1e-300))) >= limit[s]}
    got = set()
    for r in secrets.scan(spark.createDataFrame([(*d, None, None, 0) for d in docs], SCHEMA)).collect():
        got |= {(r.doc_id, int(a), int(b)) for kind, a, b in (x.split(":") for x in r.spans.split(",") if x) if kind == "random"}
    # a p-value within a thousandth of a step of its scale may fall to either side
    close = {(k, a, b) for k, a, b, _, p, least in runs if abs(3 * least / secrets.BATTERY - 1) < 0.02 or abs((-10 * math.log10(max(p, 1e-300))) % 1 - 0.5) > 0.48}
    assert (got ^ want) <= close and len(want) > 40 and len(runs) > len(want) + 40


# --- 2


def plain_words(text):
    """Words as runs of letters, digits and bytes beyond ASCII, small ASCII letters: (start, end) in bytes."""
    raw = (text or "").encode()
    return [m.span() for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", raw)], raw


def test_toxicity_equals_plain_python(spark):
    rng = random.Random(2)
    words = ["river", "stone", "green", "é", "walk", "until"]
    bad = ["vile", "vilest", "scum"]
    docs = [(k, " ".join(rng.choice(words + bad * (k % 4 == 0)) for _ in range(rng.randrange(1, 60)))) for k in range(300)]
    docs += [(900, None), (901, ""), (902, "... !"), (903, "Vile é scum, vile-SCUM river."), (904, "é " * 70 + "vile vile")]
    labels = spark.createDataFrame([(k, int(any(w in t.split() for w in bad))) for k, t in docs[:300]], "doc_id long, toxic int")
    table = spark.createDataFrame([(*d, None, None, 0) for d in docs], SCHEMA)
    w, bias, trans, doc = toxicity.fit(table, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(table, labels).collect()}
    for k, t in docs:
        spans, raw = plain_words(t)
        emit = []
        if spans:
            data = np.frombuffer(raw, np.uint8)
            starts, ends = (np.array(x) for x in zip(*spans, strict=True))
            h = toxicity.tv.hashes(data, starts, ends, toxicity.tv.LOWER)
            emit = [float(sum(w[i] for i in f)) + bias for f in toxicity.features(data, starts, ends, h).tolist()]
        ahead, behind = [], [(0.0, 0.0)] * len(emit)
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        for i, e in enumerate(emit):
            a = (0.0, 0.0) if i == 0 else ahead[-1]
            ahead.append((a[0], a[1] + e) if i == 0 else tuple(add(a[0] + trans[0, s], a[1] + trans[1, s]) + e * s for s in (0, 1)))
        for i in range(len(emit) - 2, -1, -1):
            behind[i] = tuple(add(trans[s, 0] + behind[i + 1][0], trans[s, 1] + emit[i + 1] + behind[i + 1][1]) for s in (0, 1))
        p = [1 / (1 + math.exp((a[0] + b[0]) - (a[1] + b[1]))) for a, b in zip(ahead, behind, strict=True)]
        top = min(max(max(p, default=1e-6), 1e-6), 1 - 1e-6)
        x = [math.log(top / (1 - top)) / 5, math.log(sum(p) + 1e-3), math.log1p(len(p)) / 5, 1.0]
        score = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, doc.tolist(), strict=True))))
        assert got[k].score == pytest.approx(score, abs=1e-6), k
        hit, joined = [i for i, y in enumerate(p) if y >= toxicity.SPAN], []
        for i in hit:
            if joined and joined[-1][1] == i - 1:
                joined[-1][1] = i
            else:
                joined.append([i, i])
        chars = lambda b: len(raw[:b].decode())
        assert got[k].spans == ",".join(f"{chars(spans[a][0])}:{chars(spans[b][1])}" for a, b in joined), k
    assert sum(bool(r.spans) for r in got.values()) > 50


def test_labels_of_words():
    f = lambda *ids: np.array([[i] * toxicity.N_FEATURES for i in ids])
    rows = [(1, f(1, 2, 9)), (1, f(9, 3)), (1, f(9, 9, 1))] + [(0, f(1, 2, 3))] * 30
    assert [x.tolist() for x in toxicity.word_labels(rows)] == [[0, 0, 1], [1, 0], [1, 1, 0]] + [[0, 0, 0]] * 30


# --- 7


def plain_grams(text):
    """Bucket counts by the definition: bytes of the text in lower case, every run of non-letters one space (none ahead)."""
    out, last = [], True
    for b in (text or "").lower().encode():
        letter = b >= 128 or chr(b).isalpha()
        if letter or not last:
            out.append(b if letter else 32)
        last = not letter
    out = [32] * (3 - len(out)) + out
    found = Counter()
    u = lambda x: x & 0xFFFFFFFF
    for size, add in ((3, 0), (4, 0x165667B1)):
        for i in range(len(out) - size + 1):
            x = u(sum(b * k for b, k in zip(out[i : i + size], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), strict=False)) + add)
            found[u((x ^ x >> 15) * 0x2C1B3C6D) >> 18] += 1
    return found


def test_language_predictions_equal_plain_python(spark):
    rng = random.Random(4)
    words = {"en": ["the", "of", "and", "river"], "de": ["der", "und", "über", "fluß"], "fr": ["le", "été", "rivière", "et"]}
    docs = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(2, 80))), lang) for k, lang in enumerate(rng.choice(sorted(words)) for _ in range(300))]
    docs += [(900, None, "en"), (901, "", None), (902, "123 ... 4", "de"), (903, "a", None), (904, "É", "fr"), (905, "  The, RIVER!  and 7", None), (906, "ab", None), (907, "über " * 400, None)]
    df = spark.createDataFrame([(i, t, lang, None, 0) for i, t, lang in docs], SCHEMA)
    model = langid.fit(df)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    for i, t, _ in docs:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0, True)
            continue
        found = plain_grams(t)
        n = sum(found.values())
        z = [(sum(c / n * model.table[b, k] for b, c in found.items()) + model.bias[k]) / model.temperature for k in range(len(model.langs))]
        p = [math.exp(x - max(z)) for x in z]
        best = max(range(len(p)), key=p.__getitem__)
        assert got[i].lang_pred == model.langs[best] and got[i].score == pytest.approx(p[best] / sum(p), abs=1e-9), i
        band = sum(n >= x for x in langid.LENGTHS)
        assert got[i].rejected == (got[i].score < model.thresholds[band])
    assert {r.lang_pred for r in got.values()} == {"en", "de", "fr", "und"}


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_pieces_of_a_text_add_up(piece):
    rng = random.Random(piece)
    for n in (0, 1, 2, 3, 5, 40, 500):
        text = "".join(rng.choice(["a", "é", "B", " ", "  ", "1\n", "zz"]) for _ in range(n))
        counts = langid.bucket_counts(np.frombuffer(text.lower().encode(), np.uint8), piece)
        assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == (dict(plain_grams(text)) if n else {})


# --- 12: everything that is labelled is learned from


def test_pairrank_uses_every_labelled_document(spark, monkeypatch):
    from glyphspark.llm import pairrank

    monkeypatch.setattr(pairrank, "PART_ROWS", 300)
    texts = lambda i: ("The river walked on until green stone." if i % 3 else "|| $$ 7 && ## 7") + f" {i % 7}"
    rows = [(i, texts(i)) for i in range(4000)] + [(4001, "A long one. " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 > 0 OR doc_id = 4001 AS INT) AS quality")
    found = pairrank.labelled(docs, labels).collect()
    free_ids = {r.doc_id for r in labels.where(~pairrank.held_out("doc_id")).collect()}
    assert len(free_ids) > 2 * 1500 and {r.doc_id for r in found} == free_ids and 4001 in free_ids
    mean = pairrank.fit(docs, labels)[0]
    x = pairrank._rows(*(pairrank.pa.array([r[c] for r in found if r.good], pairrank.pa.binary()) for c in ("at", "x")))
    assert np.allclose(mean, x[:, :-1].mean(0), atol=1e-6)
    out = pairrank.score_documents(docs, labels).join(labels, "doc_id").where("predicted <> quality AND doc_id < 4000").count()
    assert out == 0


@pytest.mark.parametrize(("n", "m"), [(700, 3), (1, 900), (5, 5)])
def test_pairrank_pairs_hold_every_row_in_each_epoch(n, m):
    from glyphspark.llm import pairrank

    left, right = (set() for _ in range(2))
    size = 0
    for i, j in pairrank.rounds(n, m):
        assert len(i) == len(j)
        left.update(i.tolist())
        right.update(j.tolist())
        size += len(i)
        if size == max(n, m):
            assert left == set(range(n)) and right == set(range(m))
            left, right, size = set(), set(), 0
    assert size == 0


def test_pairrank_cut_of_ranges():
    from glyphspark.llm import pairrank

    rng = np.random.default_rng(4)
    for _ in range(300):
        s = np.sort(rng.integers(0, 12, rng.integers(1, 40)).astype(float))
        y = rng.integers(0, 2, len(s))
        errors = lambda cut: ((s < cut) & (y == 1)).sum() + ((s > cut) & (y == 0)).sum()
        ends = [k for k in np.flatnonzero(np.diff(s)) + 1 if rng.random() < 0.4]
        ranges = [(float(a[0]), *pairrank.cuts(a, b)) for a, b in zip(np.split(s, ends), np.split(y, ends))]
        cut = pairrank.best_cut(ranges)
        assert cut not in s and errors(cut) == min(errors(c) for c in np.append(s + 0.5, s[0] - 1))
