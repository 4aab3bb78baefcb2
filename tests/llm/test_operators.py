import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from glyphspark.llm import chat, common, decontaminate, jaccard, langid, mixing, quality, secrets, sharding, textvec, tokencount, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", n long, key string, cls long, token long, start long, w string, comp long"


def prose(rng, n, words=("the", "tion", "and", "er", "st", "ing", "of", "re")):
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    near = []
    for t in base[:10]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    odd = [None, "", " \n\t", "é", "word", "word", "AKIA" + "A" * 12, "a" * 40, "x\ny\nx\n\nx", prose(rng, 3000), "A b C d E f", "a B c D e F", " one two"]
    return base + base[:5] + near + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 3 else None, t, ("en", "de", None)[i % 3], ("src0", "src1", None)[i % 3 if i % 5 else 2], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(None).cast("string") for c in ("n", "key", "cls", "token", "start", "w", "comp", "digest", "tier", "cap", "chosen")})


# --- words


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    rows = ["a bc  def", "", None, "été bc", " lead", "x" * 100_000 + " y"]
    raw, at = textvec.buffers(pa.array(rows))
    starts, ends, first = textvec.spans(raw, at)
    h = textvec.hashes(raw, starts, ends)
    words = [w for r in rows for w in (r or "").split()]
    assert list(np.diff(first)) == [len((r or "").split()) for r in rows]
    assert [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)] == words
    assert h[1] == h[4] and len(set(h.tolist())) == len(set(words))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# --- 1


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(1)
    rows = [None, "", "token=secret:longvalue123", "token=secret=abcdefgh", "PassWord : 'abc.def-12'", "é AKIA" + "B" * 12 + " AKIAAKIA", "f" * 31, "0" * 32 + "g" + "a" * 40, "api_key=" + "d" * 40, "ſecret=abcdefghij", "secret = 12345678\npasswd:\"zzzzzzzz\""]
    for i in range(120):
        rows.append(prose(rng, 40) + (" " + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) if i % 4 == 0 else ""))
    df = clash(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(rows)], SCHEMA))
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    for i, t in enumerate(rows):
        spans = base_spans(t)
        c = Counter(k for _, k, _ in spans)
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (c[0], c[1], c[2])
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if i < 11:
            assert got[i].spans == text
        else:
            assert (got[i].n_random > 0) == ((i - 11) % 4 == 0), t


def test_secrets_of_long_texts(spark):
    import time

    rng = random.Random(2)
    made = [rng.choice(["%032x" % rng.getrandbits(128), "token=" + "ab1" * 4, "é", "AKIA" + "Q7" * 8, "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)), "short", "x" * 25]) for _ in range(60_000)]
    text = " ".join(made)
    runs = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text)]
    base = base_spans(text)
    hit = np.zeros(len(text), bool)
    for a, _, b in base:
        hit[a:b] = True
    free = {f"random:{a}:{b}" for a, b in runs if not hit[a:b].any()}
    began = time.time()
    r = secrets.scan(spark.createDataFrame([(1, text, None, None, 0)], SCHEMA)).first()
    assert time.time() - began < 100
    spans = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
    assert len(base) > 20_000 and r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    found = {x for x in r.spans.split(",") if x.startswith("random")}
    assert found <= free and len(found) > 5_000 and not any(text[int(x.split(":")[1])] == "x" for x in found if int(x.split(":")[2]) - int(x.split(":")[1]) == 25)


# --- 2


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    n = np.array([0, 1, 5, 33, 64, 0, 130])
    first = np.concatenate(([0], np.cumsum(n)))
    e, t = rng.normal(0, 3, first[-1]), rng.normal(0, 1, (2, 2))
    want = np.zeros(len(e))
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        s = np.column_stack((np.zeros(b - a), e[a:b]))
        al, be = np.zeros_like(s), np.zeros_like(s)
        al[0] = s[0]
        for i in range(1, b - a):
            al[i] = s[i] + np.logaddexp(al[i - 1][0] + t[0], al[i - 1][1] + t[1])
        for i in range(b - a - 2, -1, -1):
            be[i] = np.logaddexp(t[:, 0] + s[i + 1][0] + be[i + 1][0], t[:, 1] + s[i + 1][1] + be[i + 1][1])
        g = al + be
        want[a:b] = 1 / (1 + np.exp(g[:, 0] - g[:, 1]))
    assert np.allclose(toxicity.marginals(e, first, t), want)


def test_field_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    n = np.array([1, 40, 0, 7])
    first = np.concatenate(([0], np.cumsum(n)))
    e, t, y = rng.normal(0, 1, first[-1]), rng.normal(0, 1, (2, 2)), rng.integers(0, 2, first[-1])

    def likelihood(e, t):
        total = 0.0
        for a, b in zip(first, first[1:]):
            if a == b:
                continue
            al = np.array([0, e[a]])
            for i in range(a + 1, b):
                al = np.logaddexp(al[0] + t[0], al[1] + t[1]) + np.array([0, e[i]])
            total += (e[a:b] * y[a:b]).sum() + t[y[a : b - 1], y[a + 1 : b]].sum() - np.logaddexp(*al)
        return total

    p, pairs = toxicity.expectations(e, first, t)
    real = np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        np.add.at(real, (y[a : b - 1], y[a + 1 : b]), 1)
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = 1e-5
            assert abs((likelihood(e, t + d) - likelihood(e, t - d)) / 2e-5 - (real - pairs)[i, j]) < 1e-5
    for k in (0, 1, 20, 47):
        d = np.zeros(len(e))
        d[k] = 1e-5
        assert abs((likelihood(e + d, t) - likelihood(e - d, t)) / 2e-5 - (y - p)[k]) < 1e-5


def test_toxicity_finds_held_out_words(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, 60).split()
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["badword", "vile", "nasty"]))
        rows.append((i, " ".join(w), None, None, 0))
        labels.append((i, int(toxic)))
    rows += [(1000, None, None, None, 0), (1001, "", None, None, 0)]
    docs, marks = clash(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    truth = dict(labels)
    held = [i for i in truth if got[i].held_out]
    assert held and sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert got[1000].score == got[1001].score < 0.5 and got[1000].spans == ""
    a, b = map(int, next(got[i].spans for i in held if truth[i]).split(",")[0].split(":"))
    assert rows[next(i for i in held if truth[i])][1][a:b] in {"badword", "vile", "nasty"}
    assert toxicity.score_documents(docs.limit(0), marks).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, marks.limit(0)).collect()} == {0.0}


# --- 3


def chat_case(rows):
    """Brute-force digests of (conv_id, turn, role, text) rows."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for _, r, t in mine if r == "assistant")
        whole = "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n" for _, r, t in mine)
        said = "".join(f"{r}\n{t}\n" for _, r, t in mine)
        ids = chat.coder(tokencount.tokenizer_path(chat.VOCABULARY)).ids(whole)
        out[c] = (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole), len(ids))
    return out


def test_chat_round_trip(spark, monkeypatch):
    p = chat.PROBE
    rows = [(1, 0, "user", p), (1, 1, "assistant", "<\\|im_end|> <\\\\| x <"), (1, 1, "assistant", None), (2, 5, "sys\ntem", "\n\n lead é"), (2, 6, "assistant", "\n\n  é\U0001f600 <|endoftext|> "), (None, 0, None, "a"), (3, 0, "user", ""), (5, None, "assistant", "x"), (5, None, "assistant", "x")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"word {p} don't 12,5 é " * 300) for i in range(80)]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = chat_case(rows)
    for hot in (4096, 10):
        monkeypatch.setattr(chat, "PIECE_ROWS", hot)  # the second time conversation 4 is cut into pieces
        assert {r[0]: tuple(r)[1:] for r in chat.conversation_digests(df).collect()} == want
        parts = chat.format_conversations(df)
        assert parts.where("conv_id = 4").count() > (1 if hot > 10 else 20)
        assert {r[0]: tuple(r)[1:] for r in chat.read_back(parts).collect()} == want
    r = parts.where("conv_id = 1").first()
    assert [t.role for t in r.turns] == ["user", "assistant", "assistant"]
    assert len(r.token_ids) == len(r.token_begins) == len(r.token_ends) == len(r.loss_begins) == len(r.loss_ends)
    assert chat.conversation_digests(df.limit(0)).count() == 0 and chat.format_conversations(df.limit(0)).count() == 0


def test_chat_long_turns(spark):
    texts = ["word <|x|> é " * 800_000, "x" * 300_000 + "1" * 150_000, " " * 200_000 + "a", "añ\u00a0" * 100_000, "no-space," * 40_000]
    rows = [(k, 0, "assistant", t) for k, t in enumerate(texts)] + [(9, 0, "user", "a"), (9, 1, "assistant", texts[1]), (9, 2, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert len(texts[0]) > 10_000_000
    assert {r[0]: tuple(r)[1:] for r in chat.conversation_digests(df).collect()} == chat_case(rows)


def test_chat_tokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokencount.tokenizer_path())
    plain.add_special_tokens([chat.START, chat.END])
    code = chat.coder(tokencount.tokenizer_path(chat.VOCABULARY))
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "\n", "é", "\U0001f600", "12", "'s", "<|", "\u00a0", "\u1f600"]) for _ in range(3000))
    text = "".join(x for x, _ in chat.rendered([("user", text), ("assistant", text)], 10**9))
    whole = plain.encode(text, add_special_tokens=False)
    ids, begin, end = code.encode(text)
    assert whole.ids == ids.tolist() and whole.offsets == list(zip(begin.tolist(), end.tolist()))
    for most in (50, 333):
        assert np.concatenate([code.ids(x) for x, _ in chat.rendered([("user", text), ("assistant", text)], most)]).tolist() == code.ids("".join(x for x, _ in chat.rendered([("user", text), ("assistant", text)], 10**9))).tolist()


# --- 4


def test_shards_hold_every_row_once(spark, docs, tmp_path):
    store = sharding.ShardTable(spark, str(tmp_path / "s"), target=20_000, small=500, fanout=3)
    assert store.append(docs.limit(0)) == 0
    for k in range(7):
        store.append(docs.where(f"coalesce(doc_id, 0) % 7 = {k}"))
        store.compact()
    assert sharding.ShardTable(spark, str(tmp_path / "none")).read().count() == 0
    assert sorted(map(str, store.read().select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    tiers = Counter(r["tier"] for r in store.manifest())
    assert max(tiers.values()) < 3
    assert not store._commit(store.version() - 1, [], store.columns()) and store.manifest()
    assert store.read(1).count() == docs.where("coalesce(doc_id, 0) % 7 = 0").count()  # merged since, still readable
    gone = store.vacuum()
    assert gone and not {r["name"] for r in store.manifest()} & set(gone) and store.read().count() == docs.count()
    odd = sharding.ShardTable(spark, str(tmp_path / "odd"))
    odd.append(spark.createDataFrame([(1, 99, 98)], "doc_id long, __run long, __SHARD long").coalesce(1))
    assert [tuple(r) for r in odd.read().collect()] == [(1, 99, 98, 0, 0)] and odd.read().columns[-2:] == ["___run", "___shard"]


def test_lost_commit_leaves_nothing(spark, docs, tmp_path, monkeypatch):
    store = sharding.ShardTable(spark, str(tmp_path / "s"), fanout=2)
    for _ in range(2):
        store.append(docs.limit(5))
    real, lost = store._commit, []

    def commit(base, runs, columns):
        if not lost:
            lost.append(base)
            return False
        return real(base, runs, columns)

    monkeypatch.setattr(store, "_commit", commit)
    store.compact()
    assert lost and store.read().count() == 10 and len(list((tmp_path / "s" / "runs").iterdir())) == 3


def test_sharding_of_documents(spark, docs):
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    got = sharding.shard_documents(clash(docs)).toPandas()
    assert len(got) == docs.count() and got["doc_id"].nunique() == docs.count() - 1


# --- 5


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = list(zip(w, w[1:], w[2:]))
    c = Counter(grams)
    cov = {j for i, g in enumerate(grams) if c[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), n < 50 or 100 * len(cov) > 50 * n


def test_quality(spark, docs, texts, empty, monkeypatch):
    for _ in range(2):
        got = Counter(tuple(r)[1:7] for r in quality.quality_verdicts(clash(docs)).collect())
        assert got == Counter(measured(t) for t in texts)
        monkeypatch.setattr(quality, "PLACE", 61)  # three bits of hash: many windows share them
    assert quality.quality_verdicts(empty).count() == 0


def test_quality_drops_symbol_noise_only(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(w + ("#%*" if i % 50 == 0 else "") for w in prose(rng, 120).split()), "en", "a", 0) for i in range(300)]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept == (i % 50 != 0 and not got[i].base_failed) for i in range(300))


def test_quality_thresholds_equal_brute_force(spark):
    """Groups of under 200 rows or of more, a quarter of one source junk, one source that is all symbols."""
    rng = random.Random(21)
    rows = []
    for source, n, kind in (("hot", 400, "junk"), ("plain", 800, ""), ("code", 210, "code"), ("few", 20, "")):
        for i in range(n):
            words = prose(rng, rng.randint(60, 120)).split()
            if kind == "code":
                words = [w + "#" * rng.randint(0, 1) for w in words]
            if kind == "junk" and i % 4 == 0:
                words = [w + "#%*" for w in words]
            rows.append((len(rows), "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10)), "en", source, 0))

    def signals(t):
        w, chars, symbols, dup, repeat, failed = measured(t)
        lines = [x for x in t.split("\n") if x.strip()]
        return {"mean_word": chars / w, "symbol_rate": symbols / w, "dup_line_rate": dup / len(lines), "repeat_rate": repeat / w}, failed

    found = [(r[3], *signals(r[1])) for r in rows]

    def bounds(keys):
        out = {}
        for s, (sides, floor) in quality.SIGNALS.items():
            q = np.quantile([x[s] for k, x, failed in found if k in keys and not failed], [0.1, 0.5, 0.9], method="inverted_cdf")
            out[s] = (q[2] + max(4 * (q[2] - q[1]), floor), q[1] + max(4 * (q[1] - q[0]), floor), q[0] - max(4 * (q[1] - q[0]), floor) if sides == "both" else -1, q[1] - max(4 * (q[2] - q[1]), floor) if sides == "both" else -1)
        return out

    every = bounds({"hot", "plain", "code", "few"})
    own = {k: bounds({k}) for k in ("hot", "plain", "code")} | {"few": every}
    sure, odd = 0, []
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r, (k, x, failed) in zip(rows, found):
        room = []
        for s in quality.SIGNALS:
            high, mirror, low, down = own[k][s]
            room += [min(high, max(every[s][0], mirror)) - x[s], x[s] - max(low, min(every[s][2], down))]
        if failed or abs(min(room)) > 0.05:  # sketches of more than 200 rows are not exact
            sure += 1
            odd += [(*r[::3], room)] * int(got[r[0]] != (not failed and min(room) >= 0))
    assert sure > 0.9 * len(rows) and not odd
    assert not any(got[r[0]] for r in rows if r[3] == "hot" and r[0] % 4 == 0)
    assert all(got[r[0]] or f[2] for r, f in zip(rows, found) if r[3] == "code")


# --- 6


def test_leaks(spark, empty):
    rng = random.Random(8)
    every = [prose(rng, 400) for _ in range(30)]
    items = [(i, f"{prose(rng, 25)} q{i}x. {prose(rng, 8)} a{i}y.") for i in range(20)] + [(20, None), (21, ""), (22, "only one sentence here without an end"), (23, prose(rng, 300))]
    docs = [(i, t, None, None, 0) for i, t in enumerate(every)]
    want = set()
    for k, (i, t) in enumerate(items):
        if t:
            host = every[k % 30].split()
            docs.append((100 + k, " ".join(host[:200] + t.upper().split() + host[200:]), None, None, 0))
            want.add((100 + k, i))
    half = items[0][1].split(". ")
    docs += [(500, every[0] + " " + half[0] + " " + every[1], None, None, 0), (501, None, None, None, 0), (502, items[3][1], None, None, 0)]
    want.add((502, 3))
    df = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(clash(df), bench).collect()} == want
    assert {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()} == {d[0] for d in docs} - {d for d, _ in want}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.find_leaks(empty, bench).count() == 0


def exhaustive_bm25(docs, items):
    """{(doc, item): (score, n_passages)} by the definition, every passage against every item."""
    import math

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    parts = {}
    for key, text in items:
        cut = [w for w in map(words, re.split(r"[.?!]\s+|\n+", text or "")) if w]
        if len(cut) > 1:
            parts[key] = (sum(cut[:-1], []), cut[-1])
        elif cut:
            k = len(cut[0]) - max(1, len(cut[0]) // 3)
            parts[key] = (cut[0][:k], cut[0][k:])
    df = Counter(w for q, a in parts.values() for w in set(q + a))
    mean = sum(len(q + a) for q, a in parts.values()) / max(1, len(parts))

    def weights(q, a):
        tf = Counter(q + a)
        s = {w: math.log1p((len(parts) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(q + a) / mean)) for w, n in tf.items()}
        return {w: x / sum(s.values()) for w, x in s.items()}

    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = {}
    for key, (q, a) in parts.items():
        size = 128
        while size < 2 * len(q + a):
            size *= 2
        mine = weights(q, a)
        for doc, text in docs:
            w = words(text)
            at = 0
            while w:
                score = sum(mine.get(x, 0) for x in set(w[at : at + size]))
                if score >= 0.6 - 1e-9:
                    near = w[max(0, at - size // 2) : min(len(w), at + size) + size // 2]
                    share = [len(grams(x, min(3, len(x))) & grams(near, min(3, len(x)))) / len(grams(x, min(3, len(x)))) if x else 1.0 for x in (q, a)]
                    if min(share) >= 0.6:
                        best, n = out.get((doc, key), (0, 0))
                        out[doc, key] = max(best, score), n + 1
                if at + size >= len(w):
                    break
                at += size // 2
    return out


def test_leaks_equal_exhaustive_bm25(spark, monkeypatch):
    rng = random.Random(12)
    words = [prose(rng, 1) for _ in range(60)] + [f"w{i}" for i in range(150)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{say(rng.choice([4, 12, 40, 90, 200]))}. {say(rng.choice([1, 3, 10]))}") for i in range(60)] + [(None, say(30) + ". " + say(4)), (60, say(20)), (60, say(21))]
    docs = []
    for i in range(80):
        t = say(rng.choice([0, 20, 150, 700])).split()
        for _ in range(rng.choice([0, 1, 3])):
            leak = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 1, len(leak) // 6, len(leak) // 3])):
                leak[rng.randrange(len(leak))] = rng.choice(words)
            k = rng.randrange(len(t) + 1)
            t[k:k] = leak
        docs.append((i, " ".join(t)))
    docs.append((80, say(300) + " " + items[60][1]))  # the item without an id
    df = spark.createDataFrame([(*d, None, None, 0) for d in docs], SCHEMA)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    keyed = list(enumerate(t for _, t in items))
    want = sorted((d, str(items[k][0]), round(x, 6), n) for (d, k), (x, n) in exhaustive_bm25(docs, keyed).items())
    assert len(want) > 40 and any(w[1] == "None" for w in want)
    for block, cursors in ((1 << 18, 1 << 21), (200, 50)):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        monkeypatch.setattr(decontaminate, "CURSORS", cursors)
        assert sorted((r.doc_id, str(r.item_id), round(r.score, 6), r.n_passages) for r in decontaminate.find_leaks(df, bench).collect()) == want


def test_blocks_of_the_index_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, prose(rng, 30) + f" z{i}. tail{i} " + prose(rng, 5)) for i in range(12)]
    df = spark.createDataFrame([(i, prose(rng, 50) + " " + t, None, None, 0) for i, t in items], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r)[:2] for r in decontaminate.find_leaks(df, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    monkeypatch.setattr(decontaminate, "CURSORS", 5)
    assert {tuple(r)[:2] for r in decontaminate.find_leaks(df, bench).collect()} == one == {(i, i) for i in range(12)}


# --- 7


def test_language_id(spark, empty):
    rng = random.Random(6)
    vocab = {"xx": ("the", "tion", "and"), "yy": ("äuß", "sch", "ung"), "zz": ("ño", "cion", "lla")}
    rows = [(i, prose(rng, rng.randint(1, 80), vocab[k]).upper() if i % 7 == 0 else prose(rng, rng.randint(1, 80), vocab[k]), k, None, 0) for i, k in enumerate(["xx", "yy", "zz"] * 100)]
    rows += [(900, None, "xx", None, 0), (901, "12 34 !!", "xx", None, 0), (902, "", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.identify(clash(df)).collect()}
    held = [r for r in rows[:300] if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[900].score == 0
    kept = {r.doc_id for r in langid.keep_identified(df).collect()}
    assert not kept & {900, 901, 902} and len(kept) >= 295
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df["source"])).collect()} == {"und"}


def test_unlearned_language_is_rejected(spark):
    rng = random.Random(16)
    vocab = {"xx": ("the", "tion", "and"), "yy": ("äuß", "sch", "ung"), "zz": ("ño", "cion", "lla")}
    rows = [(i, prose(rng, rng.randint(5, 80), vocab[k]), k, None, 0) for i, k in enumerate(["xx", "yy", "zz"] * 100)]
    rows += [(1000 + i, prose(rng, rng.randint(20, 80), ("ырв", "ком", "дж") if i % 2 else ("qv", "wkx", "jzp")), None, None, 0) for i in range(40)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.rejected for r in got if r.doc_id >= 1000) >= 36
    assert sum(r.rejected for r in got if r.doc_id < 1000) <= 5


def test_every_language_is_learned(spark):
    rows = [(i * 2, f"w{k}x" * 4 + " " + f"q{k}" * 3, f"l{k:03}", None, 0) for i, k in enumerate(list(range(230)) * 3)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert len(model.langs) == len({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}) > 200


# --- 8


def test_token_counts(spark, docs, texts, empty, tmp_path):
    t = tokencount.load(tokencount.tokenizer_path())
    cache = str(tmp_path / "cache")
    want = Counter((len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for x in [*texts, "a <|endoftext|> b"])
    extra = docs.unionByName(spark.createDataFrame([(777, "a <|endoftext|> b", None, None, 0)], SCHEMA))
    for _ in range(2):
        got = tokencount.token_counts(clash(extra), cache).collect()
        assert Counter((r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
        assert spark.read.parquet(cache).count() == len({x or "" for x in texts}) + 1  # the second run encodes nothing
    assert tokencount.token_counts(empty).count() == 0


def test_long_texts_in_parts():
    rng = random.Random(0)
    t = tokencount.load(tokencount.tokenizer_path())
    for text in (prose(rng, 3000), "x" * 5000, ("é \n  a 12,5 " * 500) + prose(rng, 200)):
        assert tokencount.count_texts([text], tokencount.tokenizer_path(), most=500) == [len(t.encode(text, add_special_tokens=False).ids)]


# --- 9


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_equals_brute_force(spark, empty):
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = prose(rng, rng.choice([3, 8, 40, 150, 1400])).split()
        for _ in range(rng.choice([1, 4, 25])):
            w = base.copy()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = "".join(rng.choice(string.ascii_letters) for _ in range(6))
            rows.append(" ".join(w))
    passage = prose(rng, 60)
    rows += [passage + " " + prose(rng, rng.choice([5, 20, 80])) for _ in range(40)] + [None, "", "One Two", "one two"]
    docs = spark.createDataFrame([(i * 3, t, None, None, 0) for i, t in enumerate(rows)], SCHEMA)
    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in jaccard.jaccard_components(clash(docs)).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {i * 3: (len(s), find(i) * 3) for i, s in enumerate(sets)}
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {find(i) * 3 for i in range(len(rows))}
    assert jaccard.jaccard_components(empty).count() == 0


def test_every_link_counts(spark):
    """Sixty distinct texts that all link, with copies, and texts that link with a few of them."""
    rng = random.Random(8)
    base = prose(rng, 300).split()
    rows = []
    for k in range(60):
        w = base.copy()
        w[rng.randrange(len(w))] = f"only{k}"
        rows += [" ".join(w)] * (1 + k % 3)
    for k in range(20):
        w = base.copy()
        for _ in range(8):
            w[rng.randrange(len(w))] = f"far{k}"
        rows.append(" ".join(w))
    sets = [shingles(t) for t in rows]
    links = [sum(i != j and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(rows)], SCHEMA)
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_components(docs).collect()} == dict(enumerate(links))
    assert len(set(links)) > 3 and max(links) > 119


def test_blocks_of_a_family_lose_no_link(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 200).split()
    rows = []
    for k in range(40):
        w = base + prose(rng, k // 2).split()
        w[rng.randrange(200)] = f"only{k}"
        rows.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(rows)], SCHEMA)
    sets = [shingles(t) for t in rows]
    links = {i: sum(i != j and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    monkeypatch.setattr(jaccard, "BLOCK", 512 * 6)
    family = spark.createDataFrame([(1, i, len(s)) for i, s in enumerate(sets)], "lead long, cls long, n long")
    groups = Counter((r.low, r.high) for r in jaccard._blocked(family).collect())
    assert len(groups) > 10 and max(groups.values()) <= 20
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_components(docs).collect()} == links


def test_trees_give_the_candidates(spark, monkeypatch):
    """Dual traversal yields every pair that links, few others, and without it nothing links."""
    rng = random.Random(31)
    base = [prose(rng, 120).split() for _ in range(6)]
    rows = []
    for k in range(90):
        w = base[k % 6].copy() + prose(rng, rng.randrange(30)).split()
        for _ in range(rng.choice([0, 1, 3, 9])):
            w[rng.randrange(len(w))] = f"x{k}"
        rows.append(" ".join(w))
    sets = sorted((s for _, s in jaccard.shingle_sets(__import__("pyarrow").array(rows))), key=len)
    size = np.array([len(s) for s in sets])
    assert len({len(jaccard.bitmap(s)) for s in sets}) == 1
    tree = jaccard.SignatureTree(size, np.stack([jaccard.bitmap(s) for s in sets]))
    found = {(i, j) for a, b in tree.pairs() for i, j in zip(a.tolist(), b.tolist())}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert links and links <= found and len(found) < 90 * 89 / 2 / 3
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(rows)], SCHEMA)
    assert jaccard.jaccard_components(docs).where("n_links > 0").count() > 0
    monkeypatch.setattr(jaccard, "_near", lambda rows: rows.select(*jaccard.GROUP, "block", "cls").limit(0))
    assert {(r.n_links, r.component_id == r.doc_id) for r in jaccard.jaccard_components(docs.dropDuplicates(["text"])).collect()} == {(0, True)}


def test_null_and_repeated_ids_hide_nothing(spark):
    rng = random.Random(10)
    w = prose(rng, 100).split()
    a, b, c = w[:80], w[:93], w[5:100]
    other, leak = prose(rng, 50), prose(rng, 40)
    rows = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (2, other), (None, leak), (None, leak), (None, ""), (None, "")]
    docs = spark.createDataFrame([(*r, None, None, 0) for r in rows], SCHEMA)
    got = {(r.doc_id, r.n_shingles): (r.n_links, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got[1, 76] == (1, 1) and got[None, 89] == (2, 1) and got[2, 91] == (1, 1) and got[2, 46] == (0, 2)
    kept = sorted((str(r.doc_id), r.text) for r in jaccard.keep_one(docs).collect())
    assert kept == sorted([("1", rows[0][1]), ("2", other), ("None", leak), ("None", ""), ("None", "")])
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    clean = spark.createDataFrame([(7, other, None, None, 0), (7, leak, None, None, 0), (None, leak, None, None, 0), (None, " ".join(a), None, None, 0), (None, None, None, None, 0)], SCHEMA)
    assert sorted(str(r.text) for r in decontaminate.drop_leaks(clean, bench).collect()) == sorted([other, " ".join(a), "None"])


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f", None, None, 0), (1, "a b c d e f", None, None, 0), (None, "a b c d e f", None, None, 0), (None, None, None, None, 0)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("None", 0, None), ("None", 2, 1)]


# --- 10


def test_mixing_budgets(spark):
    leaves = [("a", "en", "s1", 100, 10), ("a", "en", "s2", 10, 5), ("b", "en", "s3", 5, 5), ("b", "de", "s4", 1000, 10)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, rows long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(df, {}, 4, 1, 2).collect()}
    # 557 of 1115 tokens: half a domain each; s2 gives its 40, s1 the rest; s3 gives its 20, s4 the rest
    assert got == {"s1": 238, "s2": 40, "s3": 20, "s4": 258}
    # more than a domain can give goes to the other
    got = {r.source: r.budget for r in mixing.leaf_budgets(df, {}, 1, 1, 1).collect()}
    assert got == {"s1": 100, "s2": 10, "s3": 5, "s4": 1000}


def test_mixing_takes_prefixes(spark, docs, texts, empty):
    got = mixing.mix(clash(docs)).collect()
    odd = mixing.mix(docs.selectExpr("*", "7 as __domain", "8 as __EPOCHS", "9 as __cut"))
    assert odd.columns[-5:] == ["__domain", "__EPOCHS", "__cut", "___domain", "___epochs"]
    assert sorted((str(r.doc_id), r["___epochs"]) for r in odd.collect()) == sorted((str(r.doc_id), r["__epochs"]) for r in got)
    assert {(r["__domain"], r["__EPOCHS"], r["__cut"]) for r in odd.collect()} == {(7, 8, 9)}
    assert got and all(1 <= r["__epochs"] <= mixing.EPOCHS for r in got)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts)
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) * r["__epochs"] for r in got)
    longest = max(len((t or "").split()) for t in texts)
    assert abs(taken - words * 3 // 4) <= 9 * longest
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["__epochs"] for r in got)
    assert mixing.mix(empty).count() == 0
