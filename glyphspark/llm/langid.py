"""Operator 7, language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Contract of `identify`: every row comes back with lang_pred, score and rejected. Languages are learned from text and
non-null lang of documents outside the held-out fifth; lang, source and doc_id are never inputs of a prediction. A text
that is null or has no letter gets `und`, score 0 and is rejected. Any other text gets a learned language; score is its
calibrated probability, and rejected says that score is under the threshold that calibration rows of its length set.
Every non-null lang outside the held-out fifth is learned, from one document at least. Whole texts are
read; very long ones in pieces whose counts add up. Without any labelled row every text gets `und`. Repeated rows get
equal results; extra columns are ignored.

Features are the hashed byte n-grams (3 and 4 bytes of the lower-cased text, every run of non-letters read as one
space), averaged. The training rows are a sample bounded by TRAIN_ROWS distinct texts, drawn by hash within each language;
they meet as bucket counts of at most BUCKETS entries a text in one task, which sends only the model to the driver.
"""

from __future__ import annotations

import pickle
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import held_out

BUCKETS = 1 << 14
#: Bound of the training sample: distinct texts in all, or one of each language where that is more.
TRAIN_ROWS = 3000
DIM, EPOCHS, RATE, SEED = 16, 12, 0.5, 7
#: Thresholds aim to reject this share of correct rows; so far below their mean log-odds lies it in a normal curve.
REJECT_SHARE = 0.001
REJECT_SPREAD = -NormalDist().inv_cdf(REJECT_SHARE)
#: Texts of fewer n-grams than these have thresholds of their own, as far as LEAST correct calibration rows show one.
LENGTHS, LEAST = (64, 512), 20
#: Calibration also reads the first so many bytes of its texts, as short texts are few and hardly any long one is wrong; the
#: temperature is the one of these that suits all of them best.
PIECES = (8, 16, 30, 60, 120, 250)
TEMPERATURES = (0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)

_NOT_LETTER = np.array([not (chr(b).isalpha() and b < 128 or b >= 128) for b in range(256)])


def bucket_counts(raw: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Counts over BUCKETS of the n-grams of one text's bytes, in lower case. Pieces of a long text hand their last three
    bytes on, so that each n-gram counts once."""
    out = np.zeros(BUCKETS)
    tail, in_gap, begun = np.zeros(0, np.uint32), True, 0
    for i in range(0, len(raw), piece):
        part = raw[i : i + piece]
        gap = _NOT_LETTER[part]
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        keep[0] |= not in_gap
        in_gap = bool(gap[-1])
        b = np.where(gap, 32, part)[keep].astype(np.uint32)
        begun += len(b)
        b = np.concatenate((tail, b))
        if i + piece >= len(raw) and begun < 3:
            b = np.concatenate((np.full(3 - len(b), 32, np.uint32), b))
        old = len(tail)
        tail = b[-3:]
        if len(b) < 3:
            continue
        three = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        four = three[:-1] + b[3:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
        for x in (three[max(0, old - 2) :], four):  # three bytes that were all handed on have been counted
            x ^= x >> np.uint32(15)
            out += np.bincount((x * np.uint32(0x2C1B3C6D)) >> np.uint32(18), minlength=BUCKETS)
    return out


def _lower(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column, ""))


def has_letter(column) -> np.ndarray:
    return pc.match_substring_regex(pc.fill_null(column, ""), r"\pL").to_numpy(zero_copy_only=False)


class Model:
    """langs, their scores for each bucket (the product of embedding and softmax weights), biases, temperature, and a
    threshold for each class of LENGTHS."""

    def __init__(self, langs, table, bias, temperature=1.0, thresholds=(0.0,) * (len(LENGTHS) + 1)):
        self.langs, self.table, self.bias, self.temperature, self.thresholds = langs, table, bias, temperature, thresholds

    def rejects(self, score: float, size: float) -> bool:
        return bool(score < self.thresholds[int(np.searchsorted(LENGTHS, size, "right"))])

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        return self.softmax(mean @ self.table)

    def softmax(self, plain: np.ndarray) -> np.ndarray:
        """Probabilities from the products of means and table."""
        z = (plain + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def thresholds(score: np.ndarray, size: np.ndarray) -> tuple[float, ...]:
    """The scores under which a text of each class of LENGTHS is rejected, from correct calibration rows alone: the
    REJECT_SHARE quantile, or the point that a normal curve through their log-odds gives where that is lower, as few rows
    do not show so small a share. A class of too few rows takes the shorter ones in, then all rows."""
    tier = np.searchsorted(LENGTHS, size, "right")
    out: list[float] = []
    for k in range(len(LENGTHS) + 1):
        mine = next((x for x in (score[tier == k], score[tier <= k], score) if len(x) >= LEAST), score)
        if not len(mine):
            out.append(0.0)
            continue
        p = np.clip(mine, 1e-9, 1 - 1e-9)
        odds = np.log(p / (1 - p))
        out.append(float(1 / (1 + np.exp(-min(np.quantile(odds, REJECT_SHARE), odds.mean() - REJECT_SPREAD * odds.std())))))
    return tuple(out)


def train(rows: list[tuple[str, np.ndarray, np.ndarray, list]]) -> Model | None:
    """rows: (lang, buckets, counts, the same pair for each of its PIECES) of each document. A fifth is kept for calibration."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) * 4 // 5)
    place = {k: i for i, k in enumerate(langs)}
    y = np.array([place[r[0]] for r in rows])
    # one row of each language first: all are trained, whatever falls to calibration
    first = np.unique(y[order], return_index=True)[1]
    order = np.concatenate((order[first], np.delete(order, first)))
    cut = max(cut, len(langs))
    means = [(r[1], r[2] / max(1.0, float(r[2].sum()))) for r in rows]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    w, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(order[:cut]):
            at, share = means[i]
            hidden = share @ emb[at]
            z = hidden @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            emb[at] -= rate * 30 * share[:, None] * back
    model = Model(langs, emb @ w, bias)
    held = order[cut:] if cut < len(rows) else order
    some = [(y[i], at, n) for i in held for at, n in (rows[i][1:3], *rows[i][3])]
    size = np.array([float(n.sum()) for _, _, n in some])
    plain = np.array([(n / max(1.0, float(n.sum()))) @ model.table[at] for _, at, n in some])
    truth = np.array([k for k, _, _ in some])

    def loss(t: float) -> float:
        z = (plain + bias) / t
        z -= z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]))

    model.temperature = min(TEMPERATURES, key=loss)
    p = model.softmax(plain)
    right = p.argmax(1) == truth
    model.thresholds = thresholds(p.max(1)[right], size[right])
    return model


def fit(docs: DataFrame) -> Model | None:
    usable = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1_000_000))
    usable = usable.select("lang", "text", draw.alias("draw"))
    found = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("draw")).collect()
    if not found:
        return None
    sizes = {r["lang"]: r["n"] for r in found}
    each = max(1, TRAIN_ROWS // len(sizes))
    spare = sum(max(0, each - n) for n in sizes.values())
    more = [k for k, n in sizes.items() if n > each]
    share = {k: min(1.0, (each + (spare / len(more) if k in more else 0)) / n) for k, n in sizes.items()}
    # a language's first row in order of the hash is always drawn
    rates = docs.sparkSession.createDataFrame([(r["lang"], max(share[r["lang"]] * 1_000_000, r["draw"] + 1.0)) for r in found], "lang string, rate double")
    drawn = usable.join(F.broadcast(rates), "lang").where(F.col("draw") < F.col("rate")).groupBy("lang", F.xxhash64("text")).agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches):
        for batch in batches:
            low = _lower(batch.column(1))
            raw, at = tv.buffers(low)
            b, c = [], []
            for i in range(batch.num_rows):
                whole = raw[at[i] : at[i + 1]]
                found = [bucket_counts(x) for x in (whole, *(whole[:n] for n in PIECES if n < len(whole)))]
                hits = [np.flatnonzero(x) for x in found]
                b.append([h.astype(np.int32).tobytes() for h in hits])
                c.append([x[h].astype(np.float32).tobytes() for x, h in zip(found, hits, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b, pa.list_(pa.binary())), pa.array(c, pa.list_(pa.binary()))], names=["lang", "b", "c"])

    def learn(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        pairs = [(lang, [(np.frombuffer(x, np.int32), np.frombuffer(n, np.float32)) for x, n in zip(b, c, strict=True)]) for lang, b, c in rows]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(lang, *of[0], of[1:]) for lang, of in pairs]))], pa.binary())], names=["model"])

    counts = drawn.mapInArrow(count, "lang string, b array<binary>, c array<binary>").repartition(1)
    return pickle.loads(counts.mapInArrow(learn, "model binary").first()["model"])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """See the module's docstring. Trains on docs where no model is given."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for batch in batches:
            column = batch.column(2)
            letters = has_letter(column)
            raw, at = tv.buffers(_lower(column))
            lang, score, rejected = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(letters) if m else ():
                full = bucket_counts(raw[at[i] : at[i + 1]])
                p = m.probabilities(full / full.sum())
                lang[i], score[i] = m.langs[int(p.argmax())], float(p.max())
                rejected[i] = m.rejects(score[i], full.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is in a language that the model accepts, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array) -> pa.Array:
        m = shared.value
        out = has_letter(text)
        raw, at = tv.buffers(_lower(text))
        for i in np.flatnonzero(out):
            if m:
                full = bucket_counts(raw[at[i] : at[i + 1]])
                out[i] = not m.rejects(float(m.probabilities(full / full.sum()).max()), full.sum())
        return pa.array(out)

    return docs.where(accepted("text"))
