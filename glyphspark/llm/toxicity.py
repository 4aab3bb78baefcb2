"""Operator 2, toxicity: a linear-chain conditional random field tags toxic words; marginals make the document's score.

Contract of `score_documents`: every row comes back with score (0 to 1), predicted (score >= 0.5) and spans, the offending
places as start:end in code points, comma-joined: runs of words whose marginal reaches SPAN. Only text enters a score. A
null or empty text gets the score of a document without words. Training uses the text and labels.toxic of documents
outside the held-out fifth; conflicting labels of one doc_id count as toxic if any is. Without labels of both kinds every
score is 0. Repeated rows get equal scores; extra columns are ignored. Words are runs of letters and digits, ASCII letters
in lower case.

labels.toxic marks documents, so word labels are drawn from it: within a toxic training document the words whose own or
prefix feature tells toxic from clean training documents best are labelled 1, all others 0. The field (two states, hashed
word, prefix and suffix features, transitions) is trained in numpy with forward-backward over segments; a logistic model
over the marginals' sum, maximum and the length gives the document's score. The gradient of the field is exact: marginals
of words and of neighbouring pairs, less what the labels say. Both models are fitted in one task on the same sample of
labelled rows, bounded by TRAIN_ROWS documents of each label, TRAIN_WORDS words of one and SAMPLE_WORDS in all, drawn by
hash; of the segments without a toxic word the field sees CLEAN_RATIO for each other one, CLEAN_LEAST at least.

Scoring runs forward-backward over whole texts: products of 2 by 2 matrices over pieces of STEP words, then along the
pieces of a document, then inside the pieces, so long texts cost no more per word than short ones.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import held_out

BUCKETS = 1 << 17
#: Bounds of the training sample: documents of each label, words of one, words in all.
TRAIN_ROWS, TRAIN_WORDS, SAMPLE_WORDS = 1500, 50_000, 5_000_000
#: Segments without a toxic word that the field is trained on: for each one with, and at least.
CLEAN_RATIO, CLEAN_LEAST = 3, 4000
STEP, SPAN, SEED, EPOCHS, PREFIXES = 32, 0.5, 11, 6, (4, 5, 7)
N_FEATURES = 2 + len(PREFIXES)


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(n, N_FEATURES) buckets of words: the word, its first bytes, its last four."""
    cols = [h]
    cols += [tv.hashes(raw, starts, np.minimum(starts + k, ends), tv.LOWER) * np.uint64(2 * k + 1) for k in PREFIXES]
    cols.append(tv.hashes(raw, np.maximum(starts, ends - 4), ends, tv.LOWER) * np.uint64(0x5851F42D4C957F2D))
    return (tv.mix(np.stack(cols, 1)) >> np.uint64(47)).astype(np.int32)


def _tokens(raw, at):
    starts, ends, first = tv.spans(raw, at, tv.NOT_ALNUM)
    h = tv.hashes(raw, starts, ends, tv.LOWER)
    return starts, ends, first, h


def _scan(m: list[np.ndarray], counts: np.ndarray, begin: tuple[float, float]) -> np.ndarray:
    """log(x / y) after each step of (x, y) <- (a x + b y, c x + d y), along each row's pieces. m: a, b, c, d, each (STEP, pieces)."""
    a, b, c, d = m
    pieces = a.shape[1]
    p, q, r, s = np.ones(pieces), np.zeros(pieces), np.zeros(pieces), np.ones(pieces)
    for k in range(STEP):
        p, q, r, s = a[k] * p + b[k] * r, a[k] * q + b[k] * s, c[k] * p + d[k] * r, c[k] * q + d[k] * s
        if k % 4 == 3:
            top = p + q + r + s
            p, q, r, s = p / top, q / top, r / top, s / top
    first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    x, y = np.empty(pieces), np.empty(pieces)
    u, v = np.full(len(counts), begin[0]), np.full(len(counts), begin[1])
    rank = -counts[order]
    for j in range(int(counts.max(initial=0))):
        live = order[: np.searchsorted(rank, -j, side="left")]
        at = first[live] + j
        x[at], y[at] = i, o = u[live], v[live]
        i, o = p[at] * i + q[at] * o, r[at] * i + s[at] * o
        u[live], v[live] = i / (i + o), o / (i + o)
    out = np.empty((STEP, pieces))
    for k in range(STEP):
        x, y = a[k] * x + b[k] * y, c[k] * x + d[k] * y
        top = x + y
        x, y = x / top, y / top
        np.divide(np.maximum(x, 1e-300), np.maximum(y, 1e-300), out=out[k])
    return np.log(out)


def forward_backward(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of state 1 for each word from the words up to it, and from the words behind it.

    e: score of state 1 over state 0; trans[i, j]: score of going from i to j."""
    n = np.diff(first)
    counts = -(-n // STEP)
    pieces = int(counts.sum())
    if not pieces:
        return np.zeros(0), np.zeros(0)
    start = np.concatenate(([0], np.cumsum(counts)[:-1])) * STEP
    cell = lambda at: (at % STEP) * pieces + at // STEP  # noqa: E731  place in (STEP, pieces)
    place = cell(np.arange(len(e)) + np.repeat(start - first[:-1], n))
    t = np.exp(trans)
    x = np.exp(np.clip(e, -30, 30))
    # forward: (alpha1, alpha0); the words before a row's first add equal scores
    m = [np.full((STEP, pieces), v) for v in (1.0, 0.0, 0.0, 1.0)]
    for part, v in zip(m, (x * t[1, 1], x * t[0, 1], t[1, 0], t[0, 0]), strict=True):
        part.ravel()[place] = v
    heads = first[:-1][n > 0]
    for part, v in zip(m, (0.0, x[heads], 0.0, 1.0), strict=True):
        part.ravel()[place[heads]] = v
    ahead = _scan(m, counts, (0.0, 1.0)).ravel()[place]
    # backward: the same from the other end; a step takes the next word's score with it
    back = cell(np.repeat(start + first[1:] - 1, n) - np.arange(len(e)))
    tails = first[1:][n > 0] - 1
    nxt = np.empty(len(e))
    nxt[:-1] = x[1:]
    m = [np.full((STEP, pieces), v) for v in (1.0, 0.0, 0.0, 1.0)]
    for part, v, end in zip(m, (t[1, 1] * nxt, t[1, 0], t[0, 1] * nxt, t[0, 0]), (1.0, 0.0, 0.0, 1.0), strict=True):
        part.ravel()[back] = v
        part.ravel()[back[tails]] = end
    behind = _scan(m, counts, (0.5, 0.5)).ravel()[back]
    return ahead, behind


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each word."""
    ahead, behind = forward_backward(e, first, trans)
    return 1 / (1 + np.exp(-np.clip(ahead + behind, -700, 700)))


def expectations(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each word, and the expected number of steps from state i to j over all neighbours of one row:
    P(i, j) of a pair goes with alpha(i) * trans(i, j) * score(j) * beta(j)."""
    ahead, behind = forward_backward(e, first, trans)
    p = 1 / (1 + np.exp(-np.clip(ahead + behind, -700, 700)))
    inside = np.ones(max(0, len(e) - 1), bool)
    inside[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(e))] - 1] = False
    at = np.flatnonzero(inside)
    state = np.arange(2)
    score = ahead[at, None, None] * state[:, None] + trans + (e + behind)[at + 1, None, None] * state
    score = np.exp(score - score.max((1, 2), keepdims=True))
    return p, (score / score.sum((1, 2), keepdims=True)).sum(0)


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 3) inputs of the document model: logit of the largest marginal, log of their sum, log of the length."""
    n = np.diff(first)
    out = np.zeros((len(n), 3))
    full = np.flatnonzero(n)
    top, total = np.full(len(n), 1e-6), np.zeros(len(n))
    if len(full):
        top[full] = np.clip(np.maximum.reduceat(p, first[full]), 1e-6, 1 - 1e-6)
        total[full] = np.add.reduceat(p, first[full])
    out[:, 0] = np.log(top / (1 - top)) / 5
    out[:, 1] = np.log(total + 1e-3)
    out[:, 2] = np.log1p(n) / 5
    return out


def word_labels(rows: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """0 or 1 for each word of (toxic, features) documents."""
    n = [max(1, sum(1 for y, _ in rows if y == k)) for k in (0, 1)]
    seen = np.zeros((2, BUCKETS))
    for y, f in rows:
        seen[y, np.unique(f[:, :-1])] += 1
    rate1, rate0 = (seen[1] + 0.1) / n[1], (seen[0] + 0.5) / n[0]
    weight = np.where((seen[1] >= 2) & (rate1 > 8 * rate0), np.log(rate1 / rate0) * np.sqrt(seen[1]), 0.0)
    out = []
    for y, f in rows:
        w = weight[f[:, :-1]].max(1) if len(f) else np.zeros(0)
        out.append(((w > 0) & (w >= 0.5 * w.max(initial=0))).astype(np.int8) if y else np.zeros(len(f), np.int8))
    return out


def _segments(rows, labels, size=64):
    fs, ys, ms = [], [], []
    for (_, f), y in zip(rows, labels, strict=True):
        for i in range(0, len(f), size):
            k = len(f[i : i + size])
            pad = ((0, size - k), (0, 0))
            fs.append(np.pad(f[i : i + size], pad))
            ys.append(np.pad(y[i : i + size], (0, size - k)))
            ms.append(k)
    return np.array(fs), np.array(ys), np.array(ms)


def train(rows: list[tuple[int, np.ndarray]], clean_weight: float = 1.0):
    """(weights, transitions, document model) of (toxic, features) documents; None without both labels."""
    if len({y for y, _ in rows}) < 2:
        return None
    labels = word_labels(rows)
    fs, ys, ms = _segments(rows, labels)
    rng = np.random.default_rng(SEED)
    hot = ys.any(1)
    cold = rng.permutation(np.flatnonzero(~hot))
    keep = np.sort(np.concatenate((np.flatnonzero(hot), cold[: max(CLEAN_LEAST, CLEAN_RATIO * int(hot.sum()))])))
    fs, ys, ms = fs[keep], ys[keep], ms[keep]
    w, sq = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    bias, trans, tsq = -2.0, np.zeros((2, 2)), np.full((2, 2), 1e-8)
    size = fs.shape[1]
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(fs)), max(4, len(fs) // 256)):
            f, y, n = fs[batch], ys[batch], ms[batch]
            e = w[f].sum(2) + bias
            real = np.arange(size) < n[:, None]
            flat = np.concatenate(([0], np.cumsum(n)))
            p = np.zeros(e.shape)
            p[real], pairs = expectations(e[real], flat, trans)
            d = np.where(real, p - y, 0.0)
            step = (2 * y[:, :-1] + y[:, 1:])[real[:, 1:]]
            joint = pairs - np.bincount(step, minlength=4).reshape(2, 2)
            tsq += joint**2
            trans -= 0.1 * joint / np.sqrt(tsq)
            np.clip(trans, -3, 3, out=trans)
            g = np.bincount(f.ravel(), np.repeat(d.ravel(), N_FEATURES), BUCKETS) + 1e-3 * w
            sq += g * g
            w -= 0.3 * g / np.sqrt(sq)
            bias -= 0.5 * d.sum() / max(1, real.sum())
    first = np.concatenate(([0], np.cumsum([len(f) for _, f in rows])))
    e = np.concatenate([w[f].sum(1) + bias for _, f in rows]) if first[-1] else np.zeros(0)
    x = np.column_stack((summary(marginals(e, first, trans), first), np.ones(len(rows))))
    y = np.array([r[0] for r in rows], float)
    weight = np.where(y > 0, 1.0, clean_weight)
    weight /= weight.mean()
    doc = np.zeros(4)
    for _ in range(60):  # Newton steps of a ridge-weighted logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ doc, -30, 30)))
        grad = x.T @ (weight * (q - y)) + 0.5 * doc
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(4)
        doc -= np.linalg.solve(hess, grad)
    return w, bias, trans, doc


def fit(docs: DataFrame, labels: DataFrame):
    """Trains on the sample, in one task; only the model travels to the driver."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic")).where(~held_out("__id"))
    sizes = {int(r["t"]): r["n"] for r in known.groupBy((F.col("__toxic") > 0).cast("int").alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    draw = F.when(F.col("__toxic") > 0, min(1.0, TRAIN_ROWS / sizes[1])).otherwise(min(1.0, TRAIN_ROWS / sizes[0]))
    chosen = known.where(F.pmod(F.xxhash64("__id", F.lit(SEED)), F.lit(1_000_000)) < draw * 1_000_000)

    def encode(batches):
        for batch in batches:
            raw, at = tv.buffers(batch.column(1))
            toxic, lists = [], []
            for i in range(batch.num_rows):
                part = raw[at[i] : at[i + 1]]
                starts, ends, _, h = _tokens(part, np.array([0, len(part)]))
                if 0 < len(h) <= TRAIN_WORDS:
                    toxic.append(int(batch.column(0)[i].as_py() > 0))
                    lists.append(features(part, starts, ends, h).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(lists, pa.binary())], names=["toxic", "f"])

    def learn(batches):
        rows = sorted((t, f) for b in batches for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        rng = np.random.default_rng(SEED)
        used, kept = 0, []
        for k in rng.permutation(len(rows)):
            f = np.frombuffer(rows[k][1], np.int32).reshape(-1, N_FEATURES)
            if used + len(f) <= SAMPLE_WORDS:
                used += len(f)
                kept.append((rows[k][0], f))
        taken = {k: max(1, sum(1 for y, _ in kept if y == k)) for k in (0, 1)}
        model = train(kept, (sizes[0] / sizes[1]) / (taken[0] / taken[1]))
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # at most about 2 * TRAIN_ROWS rows; of rows that share a doc_id one is used
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.max("__toxic").alias("toxic"), F.min("text").alias("text"))
    found = picked.select("toxic", "text").mapInArrow(encode, "toxic int, f binary").repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def _spans(raw, starts, ends, p) -> str:
    hit = np.flatnonzero(p >= SPAN)
    if not len(hit):
        return ""
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    cut = np.flatnonzero(np.diff(hit) > 1)
    low, high = hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))]
    return ",".join(f"{chars[starts[a]]}:{chars[ends[b]]}" for a, b in zip(low, high, strict=True))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """See the module's docstring."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(batches):
        model = shared.value
        for batch in batches:
            raw, at = tv.buffers(batch.column(2))
            scores, spans = np.zeros(batch.num_rows), [""] * batch.num_rows
            for i, j in tv.slices(at, 1 << 20) if model else ():
                w, bias, trans, doc = model
                part, off = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, first, h = _tokens(part, off)
                _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
                order = np.argsort(index)  # hashing wants words in the order of the text
                own = np.empty(len(index))
                index = index[order]
                own[order] = w[features(part, starts[index], ends[index], h[index])].sum(1) + bias
                e = own[inverse]
                p = marginals(e, first, trans)
                scores[i:j] = 1 / (1 + np.exp(-np.clip(np.column_stack((summary(p, first), np.ones(j - i))) @ doc, -700, 700)))
                row = np.searchsorted(first, np.flatnonzero(p >= SPAN), side="right") - 1
                for k in np.unique(row):
                    a, b = first[k], first[k + 1]
                    spans[i + k] = _spans(part[off[k] : off[k + 1]], starts[a:b] - off[k], ends[a:b] - off[k], p[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans)], names=["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, spans string")
