"""Operator 12, quality by pairwise ranking: a Bradley-Terry model over document features, cut at a quantile of its scores.

Contract of `score_documents`: every row comes back with held_out, score (0 to 1) and predicted (score >= CUT). Only text
enters a score. A null text is empty; an empty text gets the score of its (zero) features. Training uses text and
labels.quality of documents outside the held-out fifth; a doc_id with labels of both kinds counts as bad, one with several
rows gives its least text. Without labels of both kinds every score is 0.5. Repeated rows get equal scores, extra columns
are ignored, an empty table gives no rows.

A document's strength is a linear function of its features: shares of trigrams of character classes (letters by case,
digits, white space, each ASCII symbol), and measures of its words, lines and repeats, all over the whole text. The chance
that one document is preferred to another is the logistic function of the difference of their strengths; pairs of a good
and a bad document are the preferences, and minibatch gradients of the logistic loss of feature differences are descended
in numpy. All labelled documents are learned from, whatever their length: they are dealt by hash over two halves and parts
of about PART_ROWS, in each epoch every document of a part is in a pair of it (those of a label that the part lacks are
replaced by that label's mean), and the weights of a half are the means of its parts', by their documents. Each half is
judged by the weights of the other: of all cuts through these strengths of all labelled documents the one with the fewest
errors is the threshold. The model is the mean of the halves'. A score is the chance that the document is preferred to one
that stands at the threshold, shifted so that the threshold itself scores CUT. Features of short texts are chance, so they
are drawn towards those of good documents: by half at TRUST bytes.

Bounds: features of labelled documents are written once, their non-zero ones only; a task holds those of one part, or
CUT_ROWS strengths or so; sums and weights are added up in a stream, and the driver and the workers get the weights. Texts
are measured in pieces of PIECE bytes; a text's distinct words and windows, 8 bytes each, are what a task holds beyond that.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, durable, free, held_out

PART_ROWS, CUT_ROWS, PAIRS, EPOCHS, STEPS, BATCH = 2048, 1_000_000, 20_000, 6, 600, 200
CUT, SEED, STEP, RIDGE, PIECE = 0.3, 17, 0.05, 1e-4, 1 << 22
#: Rows whose features a task has at once, but for a part.
BUCKETS, SLICE = 1 << 10, 512

#: Class of a byte: letters by case, digits, space, line end, other control, bytes of other letters, each ASCII symbol.
CLASS = np.zeros(256, np.uint32)
for _b in range(256):
    _c = chr(_b)
    CLASS[_b] = 7 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == " " else 5 if _c == "\n" else 6 if _b < 32 or _b == 127 else _b + 8
LINE = np.zeros(256, bool)
LINE[10] = True
#: Share of upper-case letters, digits, symbols and repeated kinds; see measures.
MEASURES = ("log_words", "mean_word", "upper", "digit", "symbol", "line_ends", "distinct_words", "repeated_windows", "repeated_lines", "longest_word", "ends_in_stop", "is_empty")
#: The last column is no feature: how far the others of a text of so many bytes are to be trusted, half at TRUST bytes.
WIDTH, TRUST = BUCKETS + len(MEASURES) + 1, 25


def _trigrams(raw: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, BUCKETS) counts of class trigrams within rows; row: the row of each byte."""
    c = CLASS[raw]
    if len(c) < 3:
        return np.zeros((n, BUCKETS))
    code = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    inside = row[:-2] == row[2:]
    bucket = (code >> np.uint32(22)).astype(np.int64)
    return np.bincount((row[:-2] * BUCKETS + bucket)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(float)


def _repeats(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hashes by row: how many, how many distinct ones, how many that occur twice or more."""
    total = np.bincount(row, minlength=n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    last = np.append(new[1:], True)
    return total, np.bincount(row[new], minlength=n), total - np.bincount(row[new & last], minlength=n)


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, WIDTH) features of texts raw[at[i]:at[i + 1]]."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    row = np.repeat(np.arange(n), np.diff(at))
    grams = _trigrams(raw, row, n)
    kinds = np.stack([np.bincount(row[m], minlength=n) for m in (CLASS[raw] == 2, CLASS[raw] == 3, CLASS[raw] > 7, CLASS[raw] == 5)], 1)
    starts, ends, first = tv.spans(raw, at)
    h = tv.hashes(raw, starts, ends)
    words = np.repeat(np.arange(n), np.diff(first))
    total, distinct, _ = _repeats(h, words, n)
    w3 = tv.windows(h, 3)
    whole = words[:-2] == words[2:] if len(words) > 2 else np.zeros(0, bool)
    windows, _, again = _repeats(w3[whole], words[:-2][whole], n)
    a, b, lines = tv.spans(raw, at, LINE)
    lines = np.repeat(np.arange(n), np.diff(lines))
    n_lines, distinct_lines, _ = _repeats(tv.hashes(raw, a, b), lines, n)
    longest = np.zeros(n)
    np.maximum.at(longest, words, ends - starts)
    last = np.zeros(n, np.int64)
    last[words] = ends - 1  # of equal places the last one stays
    stop = np.where(total > 0, np.isin(raw[last], np.frombuffer(b".!?", np.uint8)), 0) if len(raw) else np.zeros(n)
    return _join(grams, size, kinds, total, np.bincount(words, ends - starts, n), distinct, windows, again, n_lines, distinct_lines, longest, stop)


def _join(grams, size, kinds, total, word_bytes, distinct, windows, again, n_lines, distinct_lines, longest, stop) -> np.ndarray:
    some = np.maximum(total, 1)
    shares = np.sqrt(grams / np.maximum(grams.sum(1), 1)[:, None])
    dense = [np.log1p(total) / 5, word_bytes / some / 5, *(np.sqrt(kinds / size[:, None]).T), distinct / some, again / np.maximum(windows, 1), (n_lines - distinct_lines) / np.maximum(n_lines, 1), np.log1p(longest) / 5, stop, total == 0]
    return np.hstack((shares, np.stack(dense, 1), (size / (size + TRUST))[:, None]))


def _cuts(raw: np.ndarray, most: int) -> list[int]:
    """Places of white space, about most bytes apart."""
    out, at = [0], most
    while at < len(raw):
        gap = np.flatnonzero(tv.SPACE[raw[at : at + most]])
        at += int(gap[0]) if len(gap) else most
        if len(gap):
            out.append(at)
            at += most
    return [*out, len(raw)]


def long_features(raw: np.ndarray, most: int = PIECE) -> np.ndarray:
    """features of one text, measured in pieces of about most bytes that end at white space."""
    grams, kinds, h, ends = np.zeros((1, BUCKETS)), np.zeros((1, 4)), [], []
    longest = word_bytes = 0
    last = 0
    cuts = _cuts(raw, most)
    for a, b in zip(cuts, cuts[1:], strict=False):
        part, back = raw[a:b], raw[max(0, a - 2) : b]
        grams += _trigrams(back, np.zeros(len(back), np.int64), 1)
        c = CLASS[part]
        kinds += [[(c == 2).sum(), (c == 3).sum(), (c > 7).sum(), (c == 5).sum()]]
        s, e, _ = tv.spans(part, np.array([0, len(part)]))
        h.append(tv.hashes(part, s, e))
        if len(s):
            longest, word_bytes, last = max(longest, int((e - s).max())), word_bytes + int((e - s).sum()), int(part[e[-1] - 1])
    h = np.concatenate(h)
    ends = np.concatenate(([-1], np.flatnonzero(raw == 10), [len(raw)]))
    a, b = ends[:-1] + 1, ends[1:]
    a, b = a[b > a], b[b > a]
    one = lambda x: _repeats(x, np.zeros(len(x), np.int64), 1)
    total, distinct, _ = one(h)
    windows, _, again = one(tv.windows(h, 3))
    n_lines, distinct_lines, _ = one(tv.hashes(raw, a, b))
    return _join(grams, np.array([float(len(raw))]), kinds, total, np.array([word_bytes]), distinct, windows, again, n_lines, distinct_lines, np.array([longest]), np.array([float(last in b".!?")]))


def batch_features(raw: np.ndarray, at: np.ndarray) -> "np.ndarray":
    """Yields (i, j, features) of rows i to j."""
    for low, high in tv.slices(at, 1 << 20):
        for i in range(low, high, SLICE):
            j = min(i + SLICE, high)
            part = raw[at[i] : at[j]]
            yield i, j, long_features(part) if j == i + 1 and len(part) > PIECE else features(part, at[i : j + 1] - at[i])


def descend(left: np.ndarray, right: np.ndarray, batches) -> np.ndarray:
    """Weights after one step for each of batches (indices into left, indices into right): left is preferred to right."""
    w, square = np.zeros(left.shape[1]), np.full(left.shape[1], 1e-8)
    for i, j in batches:
        d = left[i] - right[j]
        miss = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance given to the wrong order
        g = -(miss @ d) / len(i) + RIDGE * w
        square += g * g
        w -= STEP * g / np.sqrt(square)
    return w


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the Bradley-Terry model: a good document (y = 1) is preferred to a bad one (y = 0)."""
    rng = np.random.default_rng(SEED)
    left, right = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    return descend(x, x, ((left[k], right[k]) for _ in range(epochs) for k in np.array_split(rng.permutation(pairs), max(1, pairs // BATCH))))


def rounds(n: int, m: int):
    """Pairs (of n, of m) in batches, anew for each epoch: in every one each of both sides is in a pair, those of the smaller
    side in several. As many epochs as make STEPS steps, two at least."""
    rng, most = np.random.default_rng(SEED), max(n, m)
    batches = max(1, most // BATCH)
    for _ in range(max(2, -(-STEPS // batches))):
        i, j = np.resize(rng.permutation(n), most), np.resize(rng.permutation(m), most)
        yield from zip(np.array_split(i, batches), np.array_split(j, batches), strict=True)


def fit_part(z: np.ndarray, y: np.ndarray, means: dict[int, np.ndarray]) -> np.ndarray:
    """Weights from all rows of a part; means stand for the rows of a label that it lacks."""
    good, bad = (z[y == k] if (y == k).any() else means[k][None] for k in (1, 0))
    return descend(good, bad, rounds(len(good), len(bad)))


def threshold(strength: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The quantile of strengths, between two neighbours, below which the bad ones lie with the fewest weighted errors."""
    order = np.argsort(strength, kind="stable")
    s, y, weight = strength[order], y[order], weight[order]
    below = np.concatenate(([0.0], np.cumsum(np.where(y == 1, weight, -weight))))  # good ones lost less bad ones caught
    tied = np.concatenate(([False], s[1:] == s[:-1], [False]))
    below[tied] = np.inf
    best = np.flatnonzero(below == below.min())
    k = int(best[len(best) // 2])
    return float(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features as they differ from those of good documents, those of short texts by less."""
    return (x[:, :-1] - mean) / scale * x[:, -1:]


def cuts(s: np.ndarray, y: np.ndarray) -> tuple[int, int, float, float | None]:
    """Of sorted strengths of one range: good less bad ones in all, the least of that below a cut behind one of them, and the
    strengths on both sides of the middle one of such cuts; None is where the next range begins."""
    below = np.cumsum(np.where(y == 1, 1, -1))
    whole = np.append(np.flatnonzero(s[1:] != s[:-1]), len(s) - 1)
    best = whole[below[whole] == below[whole].min()]
    k = int(best[len(best) // 2])
    return int(below[-1]), int(below[k]), float(s[k]), float(s[k + 1]) if k + 1 < len(s) else None


def best_cut(ranges: list[tuple]) -> float:
    """The cut with the fewest errors from (first strength, *cuts) of consecutive ranges."""
    found, total = [(0, ranges[0][0] - 1)], 0
    for k, (_, all_, least, low, high) in enumerate(ranges):
        if high is None:
            high = ranges[k + 1][0] if k + 1 < len(ranges) else low + 2
        found.append((total + least, (low + high) / 2))
        total += all_
    best = [cut for errors, cut in found if errors == min(e for e, _ in found)]
    return float(best[len(best) // 2])


def scores(model: tuple | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    mean, scale, w, cut = model
    return 1 / (1 + np.exp(-np.clip(_standard(x, mean, scale) @ w - cut + np.log(CUT / (1 - CUT)), -700, 700)))


def _rows(*columns: pa.Array) -> np.ndarray:
    """Features from their places and values."""
    x = np.zeros((len(columns[0]), WIDTH))
    for k, (i, v) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
        x[k, np.frombuffer(i, np.uint16)] = np.frombuffer(v, np.float32)
    return x


def _sliced(batches):
    """Batches of SLICE rows at most."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, at, x): labels and features of all documents that may be learned from, the non-zero features and their
    places. Of rows that share a doc_id one is used."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("__good")).where(~held_out("__id"))

    def measure(batches):
        for batch in batches:
            raw, at = tv.buffers(batch.column(2))
            places, values = [], []
            for _, _, found in batch_features(raw, at):
                for x in found.astype(np.float32):
                    i = np.flatnonzero(x)
                    places.append(i.astype(np.uint16).tobytes())
                    values.append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "good", "at", "x"])

    picked = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.min("__good").alias("good"), F.min("text").alias("text"))
    return picked.select(F.col("doc_id").cast("long"), "good", "text").mapInArrow(measure, "doc_id long, good int, at binary, x binary")


def _added(parts: DataFrame) -> list:
    """Rows (key, n, v) with the sums of n and of the vectors v, added up in a stream."""

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for key, n, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = sums.setdefault(key, [0, 0.0])
                s[0], s[1] = s[0] + n, s[1] + np.frombuffer(v)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], names=["key", "n", "v"])

    few = parts.mapInArrow(add, "key int, n long, v binary").repartition(1)
    return few.sortWithinPartitions("key", "n", "v").mapInArrow(add, "key int, n long, v binary").collect()


def fit(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """Trains on all labelled documents outside the held-out fifth, part by part; only sums and weights reach the driver."""
    rows = durable(labelled(docs, labels), "features")

    def moments(batches):
        for batch in _sliced(batches):
            y, x = batch.column(1).to_numpy(), _rows(batch.column(2), batch.column(3))
            for k in (0, 1):
                if (y == k).any():
                    own, trust = x[y == k, :-1], x[y == k, -1:]
                    v = np.concatenate((own.sum(0), (own * own).sum(0), (own * trust).sum(0), trust.sum(0)))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["key", "n", "v"])

    try:
        sums = {r["key"]: (r["n"], np.frombuffer(r["v"])) for r in _added(rows.mapInArrow(moments, "key int, n long, v binary"))}
        if len(sums) < 2:
            return None
        m, total = WIDTH - 1, sum(n for n, _ in sums.values())
        mean = sums[1][1][:m] / sums[1][0]
        first, second = (sum(v[k * m : (k + 1) * m] for _, v in sums.values()) / total for k in (0, 1))
        scale = np.sqrt(np.maximum(second - first * first, 0)) + 0.02
        means = {k: (v[2 * m : 3 * m] - mean * v[3 * m]) / scale / n for k, (n, v) in sums.items()}  # of _standard

        def learn(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by("doc_id")
            y, z = table.column("good").to_numpy(), np.zeros((len(table), m), np.float32)
            for i in range(0, len(table), SLICE):
                some = table.slice(i, SLICE)
                z[i : i + SLICE] = _standard(_rows(some.column("at"), some.column("x")), mean, scale)
            w = fit_part(z, y, means) * len(y)
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([len(y)], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["key", "n", "v"])

        half = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)).cast("int").alias("half")
        part = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(-(-total // (2 * PART_ROWS)))).alias("part")
        parts = rows.select(half, part, "doc_id", "good", "at", "x").groupBy("half", "part").applyInArrow(learn, "key int, n long, v binary")
        halves = {r["key"]: np.frombuffer(r["v"]) / r["n"] for r in _added(parts)}
        judges = {k: halves.get(1 - k, halves[k]) for k in halves}  # one row in all halves of a tiny corpus has no other judge

        def judge(batches):
            for batch in _sliced(batches):
                z, of = _standard(_rows(batch.column(2), batch.column(3)), mean, scale), batch.column(0).to_numpy()
                s = np.zeros(len(z))
                for k, w in judges.items():
                    s[of == k] = z[of == k] @ w
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(s)], names=["good", "s"])

        def search(batches):
            some = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if some:
                y, s = (np.concatenate(x) for x in zip(*some, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.nulls(1, pa.float64()) for x in (float(s[0]), *cuts(s, y))], names=["first", "all", "least", "low", "high"])

        strengths = rows.select(half, "good", "at", "x").mapInArrow(judge, "good int, s double")
        dealt = strengths.repartitionByRange(total // CUT_ROWS + 1, "s") if total > CUT_ROWS else strengths.repartition(1)
        ranges = dealt.sortWithinPartitions("s", "good").mapInArrow(search, "first double, all long, least long, low double, high double").collect()
        return mean, scale, sum(halves.values()) / len(halves), best_cut(sorted(map(tuple, ranges), key=lambda r: r[0]))
    finally:
        discard(rows)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """See the module's docstring."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(batches):
        model = shared.value
        for batch in batches:
            raw, at = tv.buffers(batch.column(2))
            out = np.zeros(batch.num_rows)
            for i, j, x in batch_features(raw, at):
                out[i:j] = scores(model, x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_best(docs: DataFrame, labels: DataFrame, share: float) -> DataFrame:
    """The rows of docs whose score reaches the quantile of all scores above which share of the rows lie (ties stay).
    The quantile comes from Spark's mergeable sketch of all scores, to a ten-thousandth of the rows."""
    (name,) = free(docs.columns, "__id")
    scored = score_documents(docs, labels).groupBy("doc_id").agg(F.max("score").alias("score"))
    cut = scored.agg(F.percentile_approx("score", 1 - share, F.lit(10_000))).first()[0]
    best = scored.where(F.col("score") >= F.lit(cut)).select(F.col("doc_id").alias(name))
    return docs.join(best, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
