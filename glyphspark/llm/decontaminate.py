"""Operator 6, benchmark decontamination: every passage queries a BM25 index of the test items with block-max WAND.

Contract of `find_leaks`: rows (doc_id, item_id, score, question_overlap, answer_overlap, n_passages), one for each
document and test item whose question and answer both overlap it. Words are maximal runs of letters and digits in lower
case. Items fall into tiers by length: tier k holds those of up to PASSAGE * 2**k / 2 words. For a tier a document is cut
into overlapping passages of PASSAGE * 2**k words, half of that apart, so each run of half that length lies whole in one;
the last holds the end. The query of a passage is the set of its words. An item's BM25 score is divided by the score that
the item's own text gets, so THRESHOLD is the share of its weight that a passage must hold; all items at or above it are
retrieved. An item is a question up to its last sentence and an answer after that; where it has one sentence, the last
third of its words is the answer. Overlap is the share of the part's SHINGLE-word shingles (the part as a whole where it
is shorter) that the passage and its two neighbours hold in that order; both must reach OVERLAP. Null or empty texts and
items without words match nothing. A null item_id is reported as it is; items of other id or text are reported each,
repeated rows once. Repeated documents are reported each, rows of one id once. Extra columns are ignored.

The index: Spark splits the items and counts document frequencies and lengths over all of them; impacts are joined and
gathered by block of about BLOCK_WORDS words of one tier, and a task builds each block's index into a shared table. Blocks
reach the workers by broadcast, as many together as GROUP_BYTES hold; documents are scanned once for each such group (once
in all for some millions of item words), and each task takes HELD_BYTES of texts through one block after the other. Results
do not depend on blocks or groups.

WAND: a term's list holds the runs of RUN items with the largest impact of each. A passage whose terms' list maxima do
not add up to the threshold has no pivot and ends. The others have a cursor on the list of each essential term (the other
terms of an item hold less than LIGHT of its weight), in order of the runs they stand on. The pivot is the first run up to
which the list maxima reach the threshold; cursors behind it skip to it without reading what lies between, and only if the
block maxima there reach the threshold too is the run opened, first for essential terms, then for the full score. Many
passages go forward side by side. No bound drops an item that reaches the threshold.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import durable, free, gathered

PASSAGE, THRESHOLD, OVERLAP, SHINGLE = 128, 0.6, 0.6, 3
K1, B = 1.2, 0.75
RUN, LIGHT = 8, 0.3
#: Words of the items of one block, about; cursors that go forward together, one passage's at least.
BLOCK_WORDS, CURSORS = 1 << 18, 1 << 18
#: Bytes of blocks that are broadcast together, one at least; bytes of texts that go through the blocks together, about.
GROUP_BYTES, HELD_BYTES = 64 << 20, 8 << 20
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long"


def _words(text: str) -> np.ndarray:
    column = pc.utf8_lower(pa.array([text or ""], pa.string()))
    raw, at = tv.buffers(column)
    starts, ends, _ = tv.spans(raw, at, tv.NOT_ALNUM)
    return tv.hashes(raw, starts, ends)


def split_item(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the question and of the answer."""
    parts = [w for w in map(_words, re.split(r"[.?!]\s+|\n+", text or "")) if len(w)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(parts) > 1:
        return np.concatenate(parts[:-1]), parts[-1]
    cut = len(parts[0]) - max(1, len(parts[0]) // 3)
    return parts[0][:cut], parts[0][cut:]


def _grams(w: np.ndarray) -> np.ndarray:
    if not len(w):
        return np.zeros(0, np.uint64)
    return np.unique(tv.windows(w, min(SHINGLE, len(w))))


class Index:
    """Inverted index of one block of items, sorted by length so that neighbours share runs.

    Postings of a term: items and impacts (share of the item's own score). runs: the same for runs of RUN items, with the
    largest impact of a run (the block maximum). top: the largest impact of a term's whole list.
    """

    def __init__(self, passage: int, rows: list[tuple]):
        """rows: (item_id, question, answer, terms, impacts)."""
        rows = sorted(rows, key=lambda r: (len(r[1]) + len(r[2]), r[0] is not None, r[0]))
        self.passage, self.n = passage, len(rows)
        self.ids = [r[0] for r in rows]
        t, s = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
        i = np.repeat(np.arange(self.n), [len(r[3]) for r in rows])
        self.vocab, code = np.unique(t, return_inverse=True)
        # light terms of an item, from the least impact up, hold at most LIGHT together; the others are essential
        order = np.lexsort((s, i))
        running = np.cumsum(s[order])
        begin = np.searchsorted(i[order], np.arange(self.n))
        base = np.concatenate(([0.0], running))[begin]
        heavy = np.zeros(len(s), bool)
        heavy[order] = running - base[i[order]] > LIGHT
        self.light = np.bincount(i[~heavy], s[~heavy], self.n)
        self.full = self._lists(code, i, s)
        self.heavy = self._lists(code[heavy], i[heavy], s[heavy])
        self.top = np.zeros(len(self.vocab))
        np.maximum.at(self.top, code, s)
        n_runs = self.n // RUN + 1
        key, inverse = np.unique(code[heavy].astype(np.int64) * n_runs + i[heavy] // RUN, return_inverse=True)
        most = np.zeros(len(key))
        np.maximum.at(most, inverse, s[heavy])
        self.runs = self._lists(key // n_runs, key % n_runs, most)
        self.run_key = key  # term and run of each posting, in order: where a cursor skips to
        self.run_top = np.zeros(len(self.vocab))
        np.maximum.at(self.run_top, key // n_runs, most)
        self.run_light = np.zeros(n_runs)
        np.maximum.at(self.run_light, np.arange(self.n) // RUN, self.light)
        self.grams = [(_grams(r[1]), _grams(r[2]), len(r[1]), len(r[2])) for r in rows]

    def _lists(self, code, target, value):
        order = np.lexsort((target, code))
        return np.searchsorted(code[order], np.arange(len(self.vocab) + 1)), target[order], value[order]


def _expand(lists, owner: np.ndarray, code: np.ndarray):
    """For each (owner, term): owner, target and value of the term's postings."""
    at, target, value = lists
    n = at[code + 1] - at[code]
    begin = np.repeat(at[code] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return np.repeat(owner, n), target[begin], value[begin]


def passages(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of word ranges: size words, size // 2 apart, for rows whose words are first[i]:first[i + 1]."""
    step = size // 2
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - size) // step) + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[row] + k * step
    return row, begin, np.minimum(begin + size, first[row + 1])


def wand(index: Index, of: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, run) of the runs whose block maxima reach the threshold, for n passages with the distinct terms of each
    (of: its passage, in order)."""
    at, run, value = index.runs
    n_runs, past = len(index.run_light), len(index.run_light)
    least = THRESHOLD - 1e-9
    need = least - index.run_light.max()
    some = at[terms + 1] > at[terms]
    of, terms = of[some], terms[some]
    count = np.bincount(of, minlength=n)
    shape = (n, int(count.max(initial=0)))
    column = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    code, place, end, top, cursor = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape), np.full(shape, past)
    code[of, column], place[of, column], end[of, column] = terms, at[terms], at[terms + 1]
    top[of, column], cursor[of, column] = index.run_top[terms], run[at[terms]]
    live, found = np.arange(n), []
    while len(live) and shape[1]:
        order = np.argsort(cursor, axis=1)
        mass = np.take_along_axis(top, order, 1).cumsum(1)
        k = (mass >= need).argmax(1)
        pivot = np.where(mass[:, -1] >= need, np.take_along_axis(cursor, np.take_along_axis(order, k[:, None], 1), 1)[:, 0], past)
        on = pivot < past
        if not on.all():
            live, pivot, code, place, end, top, cursor = (x[on] for x in (live, pivot, code, place, end, top, cursor))
        x, y = np.nonzero(cursor < pivot[:, None])
        place[x, y] = np.searchsorted(index.run_key, code[x, y] * n_runs + pivot[x])
        _look(run, place, end, cursor, past, x, y)
        x, y = np.nonzero(cursor == pivot[:, None])
        bound = np.bincount(x, value[place[x, y]], len(live)) + index.run_light[np.minimum(pivot, n_runs - 1)]
        found.append((live[bound >= least], pivot[bound >= least]))
        place[x, y] += 1
        _look(run, place, end, cursor, past, x, y)
    both = [np.concatenate(z) for z in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2
    order = np.lexsort((both[1], both[0]))
    return both[0][order], both[1][order]


def _look(run, place, end, cursor, past, x, y) -> None:
    """Sets the cursors at (x, y) to the runs of their places, past the last run where their lists end."""
    there = place[x, y] < end[x, y]
    cursor[x, y] = np.where(there, run[np.minimum(place[x, y], len(run) - 1)], past)


def _pivots(index: Index, h: np.ndarray, first: np.ndarray):
    """Yields (row, begin, end, codes, runs) of each passage that has runs whose block maxima reach the threshold."""
    row, begin, end = passages(first, index.passage)
    if not len(row):
        return
    at = np.searchsorted(index.vocab, h)
    at[at == len(index.vocab)] = 0
    known = index.vocab[at] == h
    place, code = np.flatnonzero(known), at[known]
    # distinct terms of half passages; a passage is two halves
    step = index.passage // 2
    own = np.searchsorted(first, place, side="right") - 1
    base = np.concatenate(([0], np.cumsum(-(-np.diff(first) // step))))
    key = np.unique((base[own] + (place - first[own]) // step) * len(index.vocab) + code)
    unit, code = key // len(index.vocab), key % len(index.vocab)
    units = int(base[-1]) + 1
    start = np.searchsorted(unit, np.arange(units + 1))
    left = base[row] + (begin - first[row]) // step
    right = np.where(end - begin > step, left + 1, units - 1)  # the last unit is empty
    top = np.bincount(unit, index.top[code], units)
    alive = np.flatnonzero(top[left] + top[right] >= THRESHOLD - 1e-9)
    if not len(alive):
        return
    size = np.diff(start)
    chunk = np.cumsum(size[left[alive]] + size[right[alive]]) // CURSORS
    for p in np.split(alive, np.flatnonzero(np.diff(chunk)) + 1):
        both = np.concatenate((left[p], right[p]))
        n = size[both]
        of = np.repeat(np.concatenate((np.arange(len(p)), np.arange(len(p)))), n)
        terms = code[np.repeat(start[both] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        key = np.unique(of * len(index.vocab) + terms)
        of, terms = key // len(index.vocab), key % len(index.vocab)
        which, runs = wand(index, of, terms, len(p))
        for k in np.unique(which):
            yield row[p[k]], begin[p[k]], end[p[k]], terms[of == k], runs[which == k]


def _search(index: Index, h: np.ndarray, first: np.ndarray):
    """Yields (row, item, score, question overlap, answer overlap) of the passages that reach the threshold."""
    step = index.passage // 2
    for row, begin, end, mine, runs in _pivots(index, h, first):
        _, heavy, heavy_value = _expand(index.heavy, np.zeros(len(mine), np.int64), mine)
        full = None
        for low in runs * RUN:
            high = min(low + RUN, index.n)
            inside = (heavy >= low) & (heavy < high)
            part = np.bincount(heavy[inside] - low, heavy_value[inside], high - low) + index.light[low:high]
            if part.max() < THRESHOLD - 1e-9:
                continue
            full = full or _expand(index.full, np.zeros(len(mine), np.int64), mine)
            inside = (full[1] >= low) & (full[1] < high)
            score = np.bincount(full[1][inside] - low, full[2][inside], high - low)
            for i in low + np.flatnonzero(score >= THRESHOLD - 1e-9):
                near = h[max(first[row], begin - step) : min(first[row + 1], end + step)]
                q_grams, a_grams, n_q, n_a = index.grams[i]
                hold = {n: tv.windows(near, n) for n in {min(SHINGLE, n_q), min(SHINGLE, n_a)} if n}
                q = np.isin(q_grams, hold[min(SHINGLE, n_q)]).mean() if n_q else 1.0
                ans = np.isin(a_grams, hold[min(SHINGLE, n_a)]).mean() if n_a else 1.0
                yield int(row), int(i), float(score[i - low]), float(q), float(ans)


def _split(items: DataFrame) -> DataFrame:
    """(key, item_id, tier, size, question, answer) of the distinct items with words."""

    def split(batches):
        for b in batches:
            out = []
            for key, item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q, a = split_item(text)
                if len(q) + len(a):
                    tier = max(0, (2 * (len(q) + len(a)) - 1) // PASSAGE).bit_length()
                    out.append((key, item, tier, len(q) + len(a), q.view(np.int64), a.view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["key", "item_id", "tier", "size", "question", "answer"])

    rows = items.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    return rows.select(F.xxhash64("item_id", "text").alias("key"), "item_id", "text").mapInArrow(split, "key long, item_id long, tier int, size long, question array<long>, answer array<long>")


def build_index(items: DataFrame) -> DataFrame | None:
    """Table (block, tier, index) of the items' blocks; None where no item has a word."""
    parts = durable(_split(items), "items")
    tiers = parts.groupBy("tier").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()  # tiers go by powers of two
    if not tiers:
        return None
    n, mean = sum(r["n"] for r in tiers), sum(r["words"] for r in tiers) / sum(r["n"] for r in tiers)
    terms = parts.select("key", "size", F.explode(F.concat("question", "answer")).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"), F.max("size").alias("size"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    lists = terms.join(df, "term").select("key", "term", weight.alias("s")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "s"))).alias("lists"))  # of one item's words
    count = F.create_map(*[F.lit(v) for r in tiers for v in (r["tier"], -(-r["words"] // BLOCK_WORDS))])
    rows = parts.join(lists, "key").select(F.pmod("key", F.element_at(count, F.col("tier"))).alias("block"), "tier", "item_id", "question", "answer", F.col("lists.term").alias("terms"), F.col("lists.s").alias("weights"))

    def build(batches):
        held: list[tuple] = []
        mine = None

        def done():
            index = Index(PASSAGE << mine[1], held)
            return pa.RecordBatch.from_arrays([pa.array([mine[0]], pa.int64()), pa.array([mine[1]], pa.int32()), pa.array([pickle.dumps(index)], pa.binary())], names=["block", "tier", "index"])

        for b in batches:
            for block, tier, item, *arrays in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (block, tier) != mine:
                    yield done()
                    held = []
                mine = (block, tier)
                q, a, t = (np.array(x, np.int64).view(np.uint64) for x in arrays[:3])
                w = np.array(arrays[3])
                held.append((item, q, a, t, w / w.sum()))
        if held:
            yield done()

    return durable(gathered(rows, ["tier", "block"], ["item_id"]).select("block", "tier", "item_id", "question", "answer", "terms", "weights").mapInArrow(build, "block long, tier int, index binary"), "index")


def _matches(docs: DataFrame, blocks: list[bytes]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(blocks)

    def found_in(block: bytes, ids: list, texts: list[pa.Array]) -> pa.RecordBatch:
        ix = pickle.loads(block)
        best: dict[tuple[int, int], list] = {}
        begun = 0
        for column in texts:
            raw, at = tv.buffers(column)
            for i, j in tv.slices(at, 1 << 21):
                part, off = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, first = tv.spans(part, off, tv.NOT_ALNUM)
                for row, item, score, q, a in _search(ix, tv.hashes(part, starts, ends), first):
                    if q >= OVERLAP and a >= OVERLAP:
                        have = best.setdefault((begun + i + row, item), [0.0, 0.0, 0.0, 0])
                        have[:] = [max(have[0], score), max(have[1], q), max(have[2], a), have[3] + 1]
            begun += len(column)
        keys = list(best)
        cols = [pa.array([ids[k] for k, _ in keys], pa.int64()), pa.array([ix.ids[i] for _, i in keys], pa.int64())]
        cols += [pa.array([best[k][c] for k in keys], pa.float64()) for c in range(3)] + [pa.array([best[k][3] for k in keys], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in FOUND.split(", ")])

    def search(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts.append(pc.utf8_lower(pc.fill_null(batch.column(1), "")))
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from (found_in(b, ids, texts) for b in shared.value)
                ids, texts, size = [], [], 0
        if ids:
            yield from (found_in(b, ids, texts) for b in shared.value)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, FOUND)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """See the module's docstring."""
    table = build_index(items)
    out = docs.sparkSession.createDataFrame([], FOUND)
    if table is None:
        return out
    group: list[bytes] = []
    for r in table.orderBy("tier", "block").select("index").toLocalIterator():  # one row for BLOCK_WORDS words
        if group and sum(map(len, group)) + len(r["index"]) > GROUP_BYTES:
            out, group = out.unionByName(_matches(docs, group)), []
        group.append(bytes(r["index"]))
    return out.unionByName(_matches(docs, group)).distinct()


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item, columns unchanged. Decided by text, so null and repeated ids hide no leak."""
    digest, bad_id = F.xxhash64("text"), free(docs.columns, "__bad")[0]
    bad = find_leaks(docs.select(digest.alias("doc_id"), "text"), items).select(F.col("doc_id").alias(bad_id)).distinct()
    return docs.join(bad, digest == F.col(bad_id), "left_anti")
