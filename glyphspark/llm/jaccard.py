"""Operator 9, n-gram Jaccard join: exact links at similarity of three quarters or more, found with signature trees.

Contract of `jaccard_components`: a document's set holds its distinct five-word shingles (ASCII lower case, words between
ASCII white space); with fewer words, the whole sequence as one; with none or null text the set is empty and links with
nothing. Two documents link when 100 * |A & B| >= 75 * |A | B|. Every row of the input comes back once as
(doc_id, n_shingles, n_links, component_id); component_id is the smallest doc_id reachable by links, the row itself
included. n_links is the number of other rows that the row links with, copies of its own and of other texts included.
Rows with a null doc_id keep their counts and have a null component unless a linked row has an id. Repeated rows are
copies of each other. Columns beside doc_id and text are ignored.

How it scales:
1. Shingles become 64-bit hashes, straight from Arrow buffers. Equal sets form a class, so copies are never paired.
2. Two linked sets share one of their first floor(n / 4) + 1 tokens under any fixed order of tokens (prefix filter).
   The order puts tokens of many documents last, so licence lines and shared passages are no join keys. Which tokens
   those are is counted over all documents by a mergeable lossy count; it changes speed, never results.
3. The bucket of a token is led by its smallest class; all buckets with one leader make a family, so a passage that
   many sets share makes one family and not one for each of its tokens. Sets that share a token share a family.
   In families of more than CORE_BLOCKS blocks each set is held against the leader: those within an eighth of it are its core
   and lie within a quarter of each other, as Jaccard distance is a metric. They all link, so their links are counted
   from the core's size, and none of its pairs is ever made, however many near copies of one text there are. Families of
   more than BLOCK tokens are cut into blocks in order of size, each core apart; two blocks at a time, not both of one
   core, meet in a task.
4. Signature trees find the pairs of a family that may link: nodes hold the OR of their members' token bitmaps and their
   size range, and pairs of nodes are traversed together, pruned by the largest overlap they allow. A pair belongs to
   the smallest leader that both sides share, so that it counts once. The first traversal, over bitmaps alone, tells
   which sets are in a pair; only those are read in full.
5. In the task that has a group's full sets the trees are traversed again and each of their pairs is verified. Pairs
   stay inside the task: out of it come each member's number of links, weighted by copies, and its component.
   Outside of cores work grows with the square of a group of distinct near copies, as each of its links is counted, and
   a large family copies each of its sets once for each block of other sets whose sizes allow a link.
6. Components of all families come from star contractions in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import WORD, connected_components, discard, durable, free, gathered

SHINGLE = 5
#: A token counts as frequent from this share of the documents on (and FREQUENT_LEAST documents), as far as it shows in
#: pieces of text with LOCAL_LEAST documents or more. At most 1 / FREQUENT_SHARE of a document's mean size are frequent.
FREQUENT_SHARE, FREQUENT_LEAST, LOCAL_LEAST = 1e-3, 40, 3
#: A map has BITS_LEAST bits, or the next power of two from one and a half bits a token on. Sets in a leaf's node.
BITS_LEAST, LEAF = 128, 16
#: The digests of texts to read again are broadcast up to this count (8 MiB of longs, at most about 64 MiB as a hash table);
#: beyond, they are joined by shuffle.
BROADCAST_DIGESTS = 1 << 20
#: Tokens of a block of a family, a set counted as LEAST_WEIGHT at least.
BLOCK, LEAST_WEIGHT = 1 << 18, 512
#: Tokens of up to RARE sets are counted pair by pair, others as columns of a matrix, COLUMNS at a time.
RARE, COLUMNS = 8, 2048
#: Blocks from which a family has cores: they cost a shuffle of its sets, blocks up to so many copies of each.
CORE_BLOCKS = 32
#: Share of a block from which a core has blocks of its own in a family.
OWN_SHARE = 0.25
#: Tokens of the leaders of large families up to which these are broadcast (16 MiB of longs).
HEAD_TOKENS = 1 << 21
#: Pairs are compared one by one, PAIRS at a time, where there are fewer than one in SPARSE of all.
PAIRS, SPARSE = 4096, 64


def _digest():
    """Names a text, copies alike."""
    return F.xxhash64("text").alias("digest")


def shingle_sets(column, most: int = 1 << 22):
    """Yields (row, sorted distinct hashes) for each row of an Arrow string column, in order."""
    raw, at = tv.buffers(column)
    for i, j in tv.slices(at, most):
        part, off = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, first = tv.spans(part, off)
        h = tv.hashes(part, starts, ends, tv.LOWER)
        w = tv.windows(h, SHINGLE)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b - a >= SHINGLE:
                yield i + k, np.unique(w[a : b - SHINGLE + 1])
            elif b > a:
                yield i + k, np.array([tv.run_hash(h[a:b])], np.uint64)
            else:
                yield i + k, np.zeros(0, np.uint64)


def _class_of(s: np.ndarray) -> int:
    """Names a set by a 64-bit hash of its members and size."""
    if not len(s):
        return 0
    x = tv.mix(s + np.uint64(len(s)))
    y = np.bitwise_xor.reduce(tv.mix(x + np.uint64(0x51ED27)))
    return int(tv.mix(np.add.reduce(x, keepdims=True) * np.uint64(31) + y).view(np.int64)[0])


def _frequent(docs: DataFrame, n_docs: int) -> np.ndarray:
    def count(batches):
        for batch in batches:
            held: list[np.ndarray] = []
            size = 0
            found = []

            def flush():
                u, c = np.unique(np.concatenate(held), return_counts=True)
                keep = c >= LOCAL_LEAST
                found.append(pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["token", "n"]))

            for _, s in shingle_sets(batch.column(0)):
                held.append(s)
                size += len(s)
                if size > 1_500_000:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            yield from found

    least = max(FREQUENT_LEAST, int(n_docs * FREQUENT_SHARE))
    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def prefix(batches):
        late = shared.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            cls = np.zeros(batch.num_rows, np.int64)
            parts, lengths, maps = {True: [], False: []}, {k: np.zeros(batch.num_rows + 1, np.int64) for k in (True, False)}, []
            for k, s in shingle_sets(batch.column(2)):
                n[k], cls[k] = len(s), _class_of(s)
                maps.append(bitmap(s).tobytes())
                if len(s):
                    take = len(s) // 4 + 1
                    often = np.zeros(len(s), bool)
                    if len(late):
                        at = np.searchsorted(late, s)
                        at[at == len(late)] = 0
                        often = late[at] == s
                    for kind, found in ((False, s[~often][:take]), (True, s[often][: max(0, take - int((~often).sum()))])):
                        parts[kind].append(found)
                        lengths[kind][k + 1] = len(found)
            lists = []
            for kind in (False, True):
                flat = np.concatenate(parts[kind]).view(np.int64) if parts[kind] else np.zeros(0, np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum(lengths[kind]), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(cls), *lists, pa.array(maps, pa.binary())], names=["doc_id", "digest", "n_shingles", "cls", "prefix", "late", "map"])

    return docs.select(F.col("doc_id").cast("long"), _digest(), "text").mapInArrow(prefix, "doc_id long, digest long, n_shingles long, cls long, prefix array<long>, late array<long>, map binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, members) of the classes with a digest in wanted (digest): read again from their texts, whatever the ids."""

    def whole(batches):
        seen = set()
        for batch in batches:
            new = []
            for k, d in enumerate(batch.column(0).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    new.append(k)
            ids, flat, lengths = [], [], [0]
            for _, s in shingle_sets(batch.column(1).take(pa.array(new, pa.int64()))):
                ids.append(_class_of(s))
                flat.append(s)
                lengths.append(lengths[-1] + len(s))
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values))], names=["cls", "members"])

    if wanted.count() <= BROADCAST_DIGESTS:
        wanted = F.broadcast(wanted)
    found = docs.select(_digest(), "text").join(wanted, "digest", "left_semi")
    return found.mapInArrow(whole, "cls long, members array<long>").groupBy("cls").agg(F.first("members").alias("members"))


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = BITS_LEAST
    while 2 * bits < 3 * len(s):
        bits *= 2
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).view(np.uint64)


class SignatureTree:
    """Sets of one bucket in order of size. Each level joins LEAF neighbours: OR of bitmaps, size range.

    slack is the largest n - popcount below a node: two sets overlap in at most popcount(and) + the smaller slack tokens,
    as each token of a set beyond the first on a bit is in its slack.
    """

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        slack = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(sizes, sizes, maps, slack)]
        while len(self.levels[-1][0]) > 1:
            low, high, m, s = self.levels[-1]
            cut = np.arange(0, len(low), LEAF)
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_or.reduceat(m, cut, axis=0), np.maximum.reduceat(s, cut)))

    def _alive(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of node pairs (a <= b), those that may hold a link: the tests are exact bounds, in whole numbers."""
        low, high, maps, slack = self.levels[level]
        ok = (4 * high[a] >= 3 * low[b]) & (4 * high[b] >= 3 * low[a])
        a, b = a[ok], b[ok]
        for i in range(0, len(a), 20_000):
            x, y = a[i : i + 20_000], b[i : i + 20_000]
            most = np.bitwise_count(maps[x] & maps[y]).sum(1).astype(np.int64) + np.minimum(slack[x], slack[y])
            most = np.minimum(most, np.minimum(high[x], high[y]))
            good = 7 * most >= 3 * (low[x] + low[y])
            yield x[good], y[good]

    def pairs(self):
        """Yields (i, j) arrays of leaf pairs i < j that no bound rules out; depth first, so few node pairs wait at a time."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                yield a, b
                continue
            n = len(self.levels[level - 1][0])
            for i in range(0, len(a), 256):
                x = (a[i : i + 256, None, None] * LEAF + np.arange(LEAF)[:, None] + np.zeros(LEAF, np.int64)).ravel()
                y = (b[i : i + 256, None, None] * LEAF + np.zeros(LEAF, np.int64)[:, None] + np.arange(LEAF)).ravel()
                ok = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
                for p, q in self._alive(level - 1, x[ok], y[ok]):
                    if len(p):
                        todo.append((level - 1, p, q))


#: What names a group of rows that meet in one task: a family and two of its blocks.
GROUP = ["lead", "low", "high"]


def _sized(family: DataFrame) -> DataFrame:
    """The rows (lead, cls, n) of family whose size allows a link with another row of their lead: a row of the same size, or
    the next size up or down in the ratio of three quarters."""
    sizes = durable(family.groupBy("lead", "n").agg(F.count("*").alias("same")), "family-sizes")
    # sizes of a family, not its rows, pass the window
    order = Window.partitionBy("lead").orderBy("n")
    up, down = F.lead("n").over(order), F.lag("n").over(order)
    near = (F.col("same") > 1) | F.coalesce(3 * up <= 4 * F.col("n"), F.lit(False)) | F.coalesce(3 * F.col("n") <= 4 * down, F.lit(False))
    return family.join(sizes.withColumn("near", near).where("near").select("lead", "n"), ["lead", "n"], "left_semi")


def _large(family: DataFrame) -> DataFrame:
    """(lead) of the families of more than CORE_BLOCKS blocks."""
    return family.groupBy("lead").agg(F.sum(_weight()).alias("all")).where(F.col("all") > CORE_BLOCKS * BLOCK).select("lead")


def _weight():
    return F.greatest("n", F.lit(LEAST_WEIGHT)).cast("long")


def _cores(docs: DataFrame, family: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, core) of sets in large families whose distance from the leader is an eighth at most: the smallest such leader.
    Jaccard distance is a metric, so two sets of one core lie within a quarter: they link, without a comparison."""
    large = durable(_large(family), "large")
    if large.isEmpty():
        return classes.select("cls", F.col("cls").alias("core")).limit(0)
    heads = large.join(classes.select(F.col("cls").alias("lead"), F.col("n").alias("m")), "lead")
    close = family.join(heads, "lead").where("8 * least(n, m) >= 7 * greatest(n, m)").select("lead", "cls")
    digests = close.select("cls").union(large).distinct().join(classes.select("cls", "digest"), "cls").select("digest")
    sets = durable(_sets(docs, durable(digests, "core-digests")), "core-sets")
    whole = sets.join(large.withColumnRenamed("lead", "cls"), "cls").select(F.col("cls").alias("lead"), F.col("members").alias("head"))
    if (heads.agg(F.sum("m")).first()[0] or 0) <= HEAD_TOKENS:
        whole = F.broadcast(whole)

    def measure(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            (flat, at), (head, of) = _lists(table, "members"), _lists(table, "head")
            near = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = flat[at[k] : at[k + 1]], head[of[k] : of[k + 1]]
                near[k] = 15 * len(np.intersect1d(a, b, assume_unique=True)) >= 7 * (len(a) + len(b))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], names=["lead", "cls"])

    rows = close.join(sets, "cls").join(whole, "lead").select("lead", "cls", "members", "head")
    return durable(rows.mapInArrow(measure, "lead long, cls long").groupBy("cls").agg(F.min("lead").alias("core")), "cores")


def _blocked(family: DataFrame) -> DataFrame:
    """(lead, low, high, block, cls, n, core) of a family (lead, cls, n, core; no core: 0): in order of size it is cut into
    blocks of about BLOCK tokens, those of a core with OWN_SHARE of a block or more apart, and every two blocks whose sizes
    allow a link are a group (blocks low <= high), dealt out on its own; but for blocks of one core, whose pairs are known to
    link."""
    family = family if "core" in family.columns else family.withColumn("core", F.lit(0).cast("long"))
    family = family.withColumn("w", _weight())
    sizes = durable(family.groupBy("lead", "core", "n").agg(F.count("*").alias("same"), F.first("w").alias("w")), "sizes")
    large = sizes.groupBy("lead").agg(F.sum(F.col("same") * F.col("w")).alias("all")).where(F.col("all") > BLOCK).select("lead")
    own = sizes.where("core <> 0").groupBy("lead", "core").agg(F.sum(F.col("same") * F.col("w")).alias("all")).where(F.col("all") >= BLOCK * OWN_SHARE).select("lead", "core", F.col("core").alias("apart"))
    sizes = sizes.join(large, "lead").join(own, ["lead", "core"], "left").withColumn("apart", F.coalesce("apart", F.lit(0)))
    part = durable(sizes.groupBy("lead", "apart", "n").agg(F.sum("same").alias("same"), F.first("w").alias("w")), "parts")
    # sizes of a family, not its rows, pass the window
    order = Window.partitionBy("lead", "apart").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = part.select("lead", "apart", "n", "same", F.coalesce(F.sum(F.col("same") * F.col("w")).over(order), F.lit(0)).alias("start"))
    rows = family.join(large.withColumn("cut", F.lit(True)), "lead", "left").join(own, ["lead", "core"], "left").withColumn("apart", F.coalesce("apart", F.lit(0)))
    step = F.floor((F.col("start") + F.pmod(F.xxhash64("cls"), F.col("same")) * F.col("w")) / BLOCK)
    placed = rows.where("cut").join(start, ["lead", "apart", "n"]).select("lead", F.xxhash64("apart", step).alias("block"), "apart", "cls", "n", "core")
    placed = durable(placed, "placed")
    whole = rows.where("cut is null").select("lead", *[F.lit(-1).cast("long").alias(c) for c in (*GROUP[1:], "block")], "cls", "n", "core")
    ends = placed.groupBy("lead", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.first("apart").alias("apart"))
    x, y = (ends.toDF("lead", k, *[f"{c}_{k}" for c in ("least", "most", "apart")]) for k in ("low", "high"))
    sized = "4 * most_low >= 3 * least_high and 4 * most_high >= 3 * least_low"
    pairs = durable(x.join(y, "lead").where(f"low <= high and {sized} and (apart_low = 0 or apart_low <> apart_high)").select(*GROUP), "block-pairs")
    both = pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high"))))
    return whole.unionByName(placed.join(both, ["lead", "block"]).select(*GROUP, "block", "cls", "n", "core"))


def _groups(batches):
    """(key, table) of each run of rows with one GROUP, the first columns; only one is held at a time."""
    held: list[pa.RecordBatch] = []
    mine = None
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(GROUP))])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1), batch.num_rows] if batch.num_rows else []
        for i, j in zip(cut, cut[1:], strict=False):
            if held and tuple(key[:, i]) != mine:
                yield mine, pa.Table.from_batches(held).combine_chunks()
                held = []
            mine = tuple(key[:, i])
            held.append(batch.slice(i, j - i))
    if held:
        yield mine, pa.Table.from_batches(held).combine_chunks()


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def overlaps(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of the values shared by lists i < j, where list k is flat[at[k] : at[k + 1]] without repeats; 0 elsewhere."""
    m = len(at) - 1
    out = np.zeros((m, m), np.int32)
    for x in _incidence(flat, at, out):
        out += (x @ x.T).astype(np.int32)
    return np.triu(out, 1)


def _incidence(flat: np.ndarray, at: np.ndarray, out: np.ndarray):
    """Adds values of RARE lists or fewer to out, pair by pair, and yields lists by values (0 or 1) of all others that two
    lists share, COLUMNS values at a time."""
    m = len(at) - 1
    order = np.argsort(flat, kind="stable")
    row, value = np.repeat(np.arange(m), np.diff(at))[order], flat[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(value)), bool), value[1:] != value[:-1])))
    count = np.diff(np.append(start, len(value)))
    for c in range(2, min(RARE, m) + 1):
        s = start[count == c]
        for p in range(c):
            for q in range(p + 1, c):
                np.add.at(out, (row[s + p], row[s + q]), 1)
    start, count = start[count > RARE], count[count > RARE]
    for i in range(0, len(start), COLUMNS):
        s, c = start[i : i + COLUMNS], count[i : i + COLUMNS]
        x = np.zeros((m, len(s)), np.float32)
        x[row[np.repeat(s - np.cumsum(c) + c, c) + np.arange(c.sum())], np.repeat(np.arange(len(s)), c)] = 1
        yield x


def shared(flat: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values lists i and j share, for pairs i < j. Where the pairs are few among all of their lists, columns are
    compared pair by pair, else as products of matrices, which then cost less."""
    used, where = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = where[: len(i)], where[len(i) :]
    m, lengths = len(used), np.diff(at)[used]
    cut = np.concatenate(([0], np.cumsum(lengths)))
    part = flat[np.repeat(at[:-1][used] - cut[:-1], lengths) + np.arange(cut[-1])]
    if len(i) * SPARSE > m * m:
        return overlaps(part, cut)[a, b].astype(np.int64)
    few = np.zeros((m, m), np.int32)
    out = np.zeros(len(i), np.int64)
    for x in _incidence(part, cut, few):
        for k in range(0, len(i), PAIRS):
            out[k : k + PAIRS] += np.einsum("ij,ij->i", x[a[k : k + PAIRS]], x[b[k : k + PAIRS]]).astype(np.int64)
    return out + few[a, b]


def _elsewhere(key: tuple, table: pa.Table) -> np.ndarray:
    """True for members i < j whose pair belongs to another group: they share a smaller leader, or one block of two; and for
    those of one core, which are known to link."""
    lead, low, high = key
    flat, at = _lists(table, "leads")
    less = flat < lead
    out = overlaps(flat[less], np.concatenate(([0], np.cumsum(less)))[at]) > 0
    block, core = table.column("block").to_numpy(), table.column("core").to_numpy()
    out |= (core[:, None] == core) & (core != 0)
    return out | (block[:, None] == block) if low != high else out


def candidates(key: tuple, table: pa.Table, n: np.ndarray, maps: list[bytes]):
    """Yields (i, j) arrays of members i < j of a group that the dual traversal of its signature trees leaves, each pair
    once: all that may link and belong to this group."""
    other, seen = _elsewhere(key, table), np.zeros((len(n), len(n)), bool)
    bits = np.array([8 * len(m) for m in maps])
    # maps that linked sets have differ by one doubling at most: a tree of each width takes in the sets of the next one that
    # are small enough for a link, folded
    for width in np.unique(bits):
        at = np.flatnonzero((bits == width) | ((bits == 2 * width) & (9 * n <= 8 * width)))
        if len(at) < 2:
            continue
        at = at[np.lexsort((at, n[at]))]
        part = np.stack([np.bitwise_or.reduce(np.frombuffer(maps[k], np.uint64).reshape(-1, width // 64), 0) for k in at])
        for i, j in SignatureTree(n[at], part).pairs():
            i, j = np.minimum(at[i], at[j]), np.maximum(at[i], at[j])
            ok = ~other[i, j] & ~seen[i, j]
            seen[i[ok], j[ok]] = True
            if ok.any():
                yield i[ok], j[ok]


def _near(rows: DataFrame) -> DataFrame:
    """The rows (GROUP, block, cls, n, core, leads, map) that are in a candidate pair of their group, without map."""

    def walk(batches):
        for key, table in _groups(batches):
            near = np.zeros(table.num_rows, bool)
            for i, j in candidates(key, table, table.column("n").to_numpy(), table.column("map").to_pylist()):
                near[i] = near[j] = True
            kept = [*GROUP, "block", "cls", "core"]
            yield pa.RecordBatch.from_arrays([pa.array(table.column(k).to_numpy()[near]) for k in kept], names=kept)

    return gathered(rows.select(*GROUP, "block", "cls", "n", "core", "leads", "map"), GROUP, ["n", "cls"]).mapInArrow(walk, "lead long, low long, high long, block long, cls long, core long")


def _within(links: np.ndarray) -> np.ndarray:
    """The first member that each one reaches by links (symmetric)."""
    out = np.full(len(links), -1)
    for k in range(len(links)):
        if out[k] < 0:
            at = np.array([k])
            out[k] = k
            while len(at):
                at = np.flatnonzero(links[at].any(0) & (out < 0))
                out[at] = k
    return out


def _linked(rows: DataFrame) -> DataFrame:
    """(cls, root, links) of the rows (GROUP, block, cls, core, copies, leads, members) that link in their group: a member that they
    reach by links there, and the number of documents that they link with. The trees' pairs are verified, each and no
    others; pairs stay inside the task."""

    def count(batches):
        for key, table in _groups(batches):
            flat, at = _lists(table, "members")
            n, copies, cls = np.diff(at), table.column("copies").to_numpy(), table.column("cls").to_numpy()
            maps = [bitmap(flat[a:b].view(np.uint64)).tobytes() for a, b in zip(at, at[1:], strict=False)]
            link = np.zeros((len(n), len(n)), bool)
            found = list(candidates(key, table, n, maps))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                both = shared(flat, at, i, j)
                ok = 100 * both >= 75 * (n[i] + n[j] - both)
                link[i[ok], j[ok]] = link[j[ok], i[ok]] = True
            on = np.flatnonzero(link.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(cls[on]), pa.array(cls[_within(link)[on]]), pa.array((link @ copies)[on])], names=["cls", "root", "links"])

    return gathered(rows.select(*GROUP, "block", "cls", "core", "copies", "leads", "members"), GROUP, ["cls"]).mapInArrow(count, "cls long, root long, links long")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, digest, n_shingles, cls) of docs and classes (cls, comp, n_links) without the empty set."""
    n_docs = docs.select("doc_id").count()
    base = durable(_prefixes(docs, _frequent(docs, n_docs)), "prefixes")
    classes = durable(base.where("n_shingles > 0").groupBy("cls").agg(F.min("digest").alias("digest"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.first("map").alias("map")), "classes")

    # families: the sets of all tokens that one class leads
    led = lambda rows: rows.groupBy("token").agg(F.min("cls").alias("lead"), F.max("cls").alias("last")).where("lead < last").select("token", "lead")
    # rare tokens are dealt out once: the grouping and the join read the same exchange
    prefixes = durable(base.where("n_shingles > 0").groupBy("cls").agg(F.first("prefix").alias("prefix"), F.first("late").alias("late")), "class-prefixes")
    rare = prefixes.select("cls", F.explode("prefix").alias("token")).repartition("token")
    # a frequent token may be in a third of all prefixes: its leader comes from partial sums, and is joined back to rows
    # that stay where they are; there are no more leaders than frequent tokens, whose number has a bound
    often = prefixes.select("cls", F.explode("late").alias("token"))
    member = durable(rare.join(led(rare), "token").select("lead", "cls").unionByName(often.join(F.broadcast(led(often)), "token").select("lead", "cls")).distinct(), "members")
    rows = durable(base.select("doc_id", "digest", "n_shingles", "cls"), "rows")
    discard(base, prefixes)
    family = durable(_sized(member.join(classes.select("cls", "n"), "cls")), "families")
    discard(member)
    leads = durable(family.groupBy("cls").agg(F.sort_array(F.collect_list("lead")).alias("leads")), "leads")

    core = _cores(docs, family, classes)
    marked = family.join(core, "cls", "left").select("lead", "cls", "n", F.coalesce("core", F.lit(0)).cast("long").alias("core"))
    near = durable(_near(_blocked(marked).join(leads, "cls").join(classes.select("cls", "map"), "cls")), "near")
    wanted = durable(classes.join(near.select("cls").distinct(), "cls").select("digest"), "wanted")
    found = durable(_linked(near.join(leads, "cls").join(classes.select("cls", "copies"), "cls").join(_sets(docs, wanted), "cls")), "linked")

    # each set of a core links with all others of it
    mine = core.join(classes.select("cls", "copies"), "cls")
    whole = mine.groupBy("core").agg(F.sum("copies").alias("all"), F.min("cls").alias("root"))
    found = found.unionByName(mine.join(whole, "core").select("cls", "root", (F.col("all") - F.col("copies")).alias("links")).where("links > 0"))

    node = connected_components(found.select(F.col("cls").alias("src"), F.col("root").alias("dst")))
    degree = found.groupBy("cls").agg(F.sum("links").alias("links"))
    label = classes.join(node, F.col("cls") == F.col("node"), "left").join(degree, "cls", "left").select("cls", F.coalesce("component", "cls").alias("comp"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows, durable(label, "labels")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """See the module's docstring."""
    rows, classes = _labelled(docs.select("doc_id", "text"))
    least = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    root = classes.join(least, "cls").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = durable(classes.join(root, "comp").select("cls", "component_id", "n_links"), "components")
    some = F.col("n_shingles") > 0
    return rows.join(label, "cls", "left").select("doc_id", "n_shingles", F.when(some, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of each group of linked ones reduced to one: the smallest doc_id stays, one of null id only where
    no other is. Groups go by text, so texts that share a doc_id do not hide each other. Texts without a word link with
    nothing and stay; of rows equal in doc_id and text one stays, unless both are without id and word."""
    did, key = free(docs.columns, "__id", "__digest")
    marked = docs.withColumns({key: _digest(), did: F.col("doc_id").cast("long")})
    rows, classes = _labelled(docs.select("doc_id", "text"))
    first = F.min_by(F.struct("doc_id", "digest"), F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("k")
    kept = rows.join(classes.select("cls", "comp"), "cls").where("n_shingles > 0").groupBy("comp").agg(first)
    kept_id, kept_key = free(marked.columns, "__kept_id", "__kept_digest")
    kept = kept.select(F.col("k.doc_id").alias(kept_id), F.col("k.digest").alias(kept_key))
    word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    one = marked.where(word).join(kept, F.col(did).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    blank = marked.where(~word)
    one = one.unionByName(blank.where(F.col(did).isNotNull())).dropDuplicates([did, key])
    return one.unionByName(blank.where(F.col(did).isNull())).drop(did, key)
