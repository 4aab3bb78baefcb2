"""Operators 4 and 8: what their stores keep, and what they refuse."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphspark.llm import decontaminate, jaccard, sharding, tokencount

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("turn", range(3))
def test_columns_of_appends_survive_compaction(spark, tmp_path, turn):
    store = sharding.ShardTable(spark, str(tmp_path / "s"), fanout=2, small=100)
    store.append(spark.createDataFrame([(1, "a"), (2, None)], SCHEMA))
    store.append(spark.createDataFrame([(3, "c", 0.5), (4, "d", None)], f"{SCHEMA}, grade double"))
    store.compact()
    store.vacuum()
    store.append(spark.createDataFrame([(5, ["x"])], "DOC_ID long, tags array<string>"))
    store.append(spark.createDataFrame([(7, 6)], "doc_id long, extra int"))
    store.compact()
    store.vacuum()
    got = sorted(tuple(r) for r in store.read().select("doc_id", "text", "grade", "tags", "extra").collect())
    assert got == [(1, "a", None, None, None), (2, None, None, None, None), (3, "c", 0.5, None, None), (4, "d", None, None, None), (5, None, None, ["x"], None), (7, None, None, None, 6)]
    assert store.columns().fieldNames() == ["doc_id", "text", "grade", "tags", "extra"]


def test_types_that_clash_are_refused_whole(spark, tmp_path):
    store = sharding.ShardTable(spark, str(tmp_path / "s"), fanout=2)
    store.append(spark.createDataFrame([(1, "a", 1.0)], f"{SCHEMA}, w double"))
    for rows, schema in (([("x", "a")], "doc_id string, text string"), ([(1, 2)], "doc_id long, text int"), ([(1, "x")], "doc_id decimal(20,0), text string")):
        version = store.version()
        with pytest.raises(sharding.SchemaClash):
            store.append(spark.createDataFrame([tuple(None if "decimal" in schema and k == 0 else x for k, x in enumerate(r)) for r in rows], schema))
        assert store.version() == version
    store.append(spark.createDataFrame([(2, 0.5)], "doc_id int, w float"))
    with pytest.raises(sharding.SchemaClash):
        store.append(spark.createDataFrame([], "doc_id long, text boolean"))
    store.compact()
    assert sorted(map(tuple, store.read().select("doc_id", "text", "w").collect())) == [(1, "a", 1.0), (2, None, 0.5)]
    assert [f.dataType.simpleString() for f in store.columns()] == ["bigint", "string", "double"]


def test_columns_of_another_writer_are_kept(spark, tmp_path, monkeypatch):
    one, two = (sharding.ShardTable(spark, str(tmp_path / "s"), fanout=9) for _ in range(2))
    one.append(spark.createDataFrame([(1, "a")], SCHEMA))
    write = sharding.ShardTable._write

    def meanwhile(made):
        def run(self, df):
            monkeypatch.setattr(sharding.ShardTable, "_write", write)
            two.append(made)
            return write(self, df)

        return run

    monkeypatch.setattr(sharding.ShardTable, "_write", meanwhile(spark.createDataFrame([(2, True)], "doc_id long, seen boolean")))
    one.append(spark.createDataFrame([(3, 9)], "doc_id long, n long"))
    assert sorted(map(tuple, one.read().select("doc_id", "text", "seen", "n").collect())) == [(1, "a", None, None), (2, None, True, None), (3, None, None, 9)]
    monkeypatch.setattr(sharding.ShardTable, "_write", meanwhile(spark.createDataFrame([(4, "w")], "doc_id long, late string")))
    with pytest.raises(sharding.SchemaClash):
        one.append(spark.createDataFrame([(5, 1.5)], "doc_id long, late double"))
    assert one.read().count() == 4


def merged(sizes, fanout, tier):
    """Tiers of the runs after each arrival, by the rule as the docstring tells it."""
    runs, out = [], []
    for size in sizes:
        runs.append((tier(size), size))
        while True:
            full = sorted(t for t in {t for t, _ in runs} if sum(x == t for x, _ in runs) >= fanout)
            if not full:
                break
            old = [r for r in runs if r[0] == full[0]]
            runs = [r for r in runs if r[0] != full[0]] + [(max(tier(sum(s for _, s in old)), full[0] + 1), sum(s for _, s in old))]
        out.append(sorted(t for t, _ in runs))
    return out


@pytest.mark.parametrize("fanout", [2, 3])
def test_tiers_merge_as_told(spark, tmp_path, monkeypatch, fanout):
    small = 1000
    tier = lambda n: next(t for t in range(60) if n < small * fanout ** (t + 1))
    sizes = [random.Random(fanout).choice([100, 900, 1500, 5000, 30_000]) for _ in range(14)]
    store, at = sharding.ShardTable(spark, str(tmp_path / "s"), fanout=fanout, small=small), {}

    def write(self, df):  # bytes as dealt, not as Parquet has them
        size = sum(at[r.doc_id] for r in df.select("doc_id").collect())
        name = f"run-{len(list((tmp_path / 's').glob('runs/*'))):032x}"
        df.write.parquet(f"{self.root}/runs/{name}")
        return {"name": name, "bytes": size, "files": 1, "tier": tier(size)}

    for n in [*sizes, 1, small, small * fanout - 1, small * fanout, small * fanout**3]:
        assert sharding.tier_of(n, small, fanout) == tier(n)
    monkeypatch.setattr(sharding.ShardTable, "_write", write)
    for k, size in enumerate(sizes):
        at[k] = size
        store.append(spark.range(k, k + 1).select(F.col("id").alias("doc_id")))
        store.compact()
        assert sorted(r["tier"] for r in store.manifest()) == merged(sizes[: k + 1], fanout, tier)[-1]
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(len(sizes)))


# --- 8


def counted(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokencount.tokenizer_path())
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("round_bytes", [64 << 20, 4096])
def test_each_missing_text_is_encoded_once(spark, tmp_path, monkeypatch, round_bytes):
    monkeypatch.setattr(tokencount, "ROUND_BYTES", round_bytes)
    texts = ["one text that comes often"] * 500 + ["under null ids"] * 300 + [None, "", "", "é <|endoftext|>"] + [f"text {k}" for k in range(40)]
    ids = [1] * 500 + [None] * 300 + list(range(44))
    docs = spark.createDataFrame(list(zip(ids, texts, [None] * len(ids), strict=True)), "doc_id long, text string, digest string").repartition(7)
    docs.write.parquet(str(tmp_path / "docs"))
    want = sorted(zip(map(str, ids), counted([t or "" for t in texts]), strict=True))
    for frame in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        cache = str(tmp_path / f"cache-{frame is docs}")
        first = tokencount.token_counts(frame.withColumn("_metadata", F.lit(1)), cache)
        assert sorted((str(r.doc_id), r.n_tokens) for r in first.collect()) == want
        stored = spark.read.schema(tokencount.CACHE_SCHEMA).parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for t in texts})
        more = frame.unionByName(spark.createDataFrame([(9, "new", None), (9, "new", None), (1, "text 3", None)], frame.schema))
        assert tokencount.token_counts(more, cache).count() == len(ids) + 3
        assert spark.read.schema(tokencount.CACHE_SCHEMA).parquet(cache).count() == len({t or "" for t in texts}) + 1


def test_texts_are_not_shuffled(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("text")).repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    placed = tokencount._placed(docs)
    some = placed.where("row % 3 = 0").select(F.xxhash64("path").alias("file"), "row")
    cache = tokencount.TokenCache(spark, str(tmp_path / "c"))
    plans = []
    cache.append = lambda rows, name: plans.append((rows._jdf.queryExecution().executedPlan().toString(), rows.select("digest").distinct().count()))
    tokencount.encode_chosen(placed, some, cache, tokencount.tokenizer_path(), "t")
    assert "BroadcastHashJoin" in plans[0][0] and "hashpartitioning" not in plans[0][0] and plans[0][1] == some.count()


def test_cache_folder_without_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.n_tokens for r in tokencount.token_counts(docs, str(tmp_path / "c")).collect()] == [2]


# --- 9


def made_sets(rng, n):
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    sets = []
    for k in range(n):
        s = set(base[rng.random(60) < (0.95 if k % 2 else 0.5)].tolist()) | set(rng.integers(0, 2**63, int(rng.integers(0, 8))).tolist())
        sets.append(np.array(sorted(s, key=lambda x: np.uint64(x)) or [1], np.int64))
    return sets


@pytest.mark.parametrize("sparse", [1, 10**9])
def test_pairs_of_trees_are_verified(monkeypatch, sparse):
    monkeypatch.setattr(jaccard, "SPARSE", sparse)
    monkeypatch.setattr(jaccard, "RARE", 3)
    rng = np.random.default_rng(4)
    sets = made_sets(rng, 80)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    n = np.diff(at)
    leads = [[1, 7] if k % 9 == 0 else [7] for k in range(len(sets))]
    table = pa.table({"leads": pa.array(leads, pa.list_(pa.int64())), "block": pa.array([k // 2 % 2 for k in range(len(sets))], pa.int64()), "core": pa.array([5 if k in (3, 5, 7) else 0 for k in range(len(sets))], pa.int64())})
    flat = np.concatenate(sets)
    common = {(i, j): len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    links = {p for p, c in common.items() if 100 * c >= 75 * (n[p[0]] + n[p[1]] - c)}
    maps = [jaccard.bitmap(s.view(np.uint64)).tobytes() for s in sets]
    for key in ((7, -1, -1), (7, 0, 1)):
        mine = {(i, j) for i, j in links if not (i % 9 == 0 and j % 9 == 0) and not {i, j} <= {3, 5, 7} and (key[1] == key[2] or i // 2 % 2 != j // 2 % 2)}
        i, j = (np.concatenate(x) for x in zip(*jaccard.candidates(key, table, n, maps), strict=True))
        found = list(zip(i.tolist(), j.tolist(), strict=True))
        assert len(set(found)) == len(found) and mine <= set(found) and len(found) < len(common) / 2 and all(a < b for a, b in found)
        assert not any(a % 9 == 0 and b % 9 == 0 for a, b in found)
        assert [common[p] for p in found] == jaccard.shared(flat, at, i, j).tolist()
    assert len(links) > 100


def test_frequent_tokens_keep_their_links(spark):
    rng = random.Random(8)
    licence = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(300):
        words = list(licence)
        words[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(k, " ".join(f"own{k}-{m}" for m in range(40)) + " " + " ".join(licence[:20])) for k in range(300, 360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = jaccard._frequent(docs, len(rows))
    late = jaccard._prefixes(docs, frequent).agg(F.sum(F.size("late")), F.sum(F.size("prefix"))).first()
    assert len(frequent) > 50 and late[0] > 300 and late[1] > 300
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    links = {i: sum(i != j and 100 * len(a & b) >= 75 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_components(docs).collect()} == links and max(links.values()) == 299


# --- 6


def test_wand_finds_the_runs_that_reach_the_threshold():
    rng = np.random.default_rng(3)
    words = np.sort(rng.integers(1, 2**63, 300).astype(np.uint64))
    rows = []
    for k in range(150):
        own = np.sort(rng.choice(words[: 40 + 2 * k % 260], 12, replace=False))
        w = rng.random(12) ** 2
        rows.append((k, own[:8], own[8:], own, w / w.sum()))
    index = decontaminate.Index(64, rows)
    passages = [np.unique(np.concatenate((rng.choice(len(index.vocab), 30), np.flatnonzero(np.isin(index.vocab, rows[rng.integers(150)][3])) if k % 3 else []))).astype(np.int64) for k in range(60)] + [np.zeros(0, np.int64)]
    of = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    got = set(zip(*(x.tolist() for x in decontaminate.wand(index, of, np.concatenate(passages), len(passages))), strict=True))
    at, run, value = index.runs
    want = set()
    for k, p in enumerate(passages):
        for r in range(len(index.run_light)):
            mass = sum(value[j] for c in p for j in range(at[c], at[c + 1]) if run[j] == r)
            if mass > 0 and mass + index.run_light[r] >= decontaminate.THRESHOLD - 1e-9:
                want.add((k, r))
    assert got == want and len(want) > 40
    # every item that a passage holds to the threshold lies in a run that is found
    order = {i: n for n, i in enumerate(index.ids)}
    for k, p in enumerate(passages):
        for i, _, _, terms, w in rows:
            if w[np.isin(terms, index.vocab[p])].sum() >= decontaminate.THRESHOLD:
                assert (k, order[i] // decontaminate.RUN) in got


def test_documents_are_scanned_once_for_all_blocks(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)) + ". " + " ".join("".join(rng.choice("stuvwxyz") for _ in range(6)) for _ in range(12))
    items = [(k, text()) for k in range(40)]
    docs = spark.createDataFrame([(k, f"before {items[k][1]} after") for k in range(0, 40, 2)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k) for k in range(0, 40, 2)}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    for group, scans in ((64 << 20, 1), (1, None)):
        monkeypatch.setattr(decontaminate, "GROUP_BYTES", group)
        found = decontaminate.find_leaks(docs, bench)
        n = found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
        assert {tuple(r)[:2] for r in found.collect()} == want and (n == scans if scans else n > 5)


def edited(rng, base, n, tag):
    words = list(base)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"{tag}{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_cores_lose_no_link_and_count_none_twice(spark, monkeypatch, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared_part = [word() for _ in range(60)]
    bases = [[word() for _ in range(120)] for _ in range(3)] + [shared_part + [word() for _ in range(60)] for _ in range(2)]
    rows = []
    for b, base in enumerate(bases):
        for k in range(35):
            rows += [edited(rng, base, rng.choice([0, 1, 1, 2, 3, 5, 9]), f"e{b}x{k}y")] * rng.choice([1, 1, 2])
        for k in range(10):
            cut = rng.randrange(70, 120)
            rows.append(" ".join(base[:cut]) + " " + edited(rng, base[:20], 1, f"c{b}x{k}y"))
    rng.shuffle(rows)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in rows)]
    near = [[j for j, b in enumerate(sets) if i != j and 100 * len(a & b) >= 75 * len(a | b)] for i, a in enumerate(sets)]
    least = {}
    for i in range(len(rows)):
        if i not in least:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in least:
                    least[x] = i
                    todo += near[x]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for block, blocks in ((512 * 5, 1), (512 * 40, 1), (512 * 5, 8), (1 << 18, 32)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "CORE_BLOCKS", blocks)
        got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
        assert got == {i: (len(near[i]), least[i]) for i in range(len(rows))}, block
    assert len({len(x) for x in near}) > 8


def test_rows_of_a_large_family_are_linear(spark, monkeypatch):
    """Distinct near copies of one text: the leader's core brings no pair of blocks, however many there are."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    seen = []
    real = jaccard._blocked
    monkeypatch.setattr(jaccard, "_blocked", lambda family: seen.append((family.count(), real(family).count())) or real(family))
    monkeypatch.setattr(jaccard, "BLOCK", 512 * 20)
    monkeypatch.setattr(jaccard, "CORE_BLOCKS", 4)
    for n in (400, 1600):
        docs = spark.createDataFrame([(k, edited(rng, base, 1, f"n{n}k{k}x")) for k in range(n)], "doc_id long, text string").repartition(4)
        got = jaccard.jaccard_components(docs).collect()
        assert {r.n_links for r in got} == {n - 1} and {r.component_id for r in got} == {0}
    (a, x), (b, y) = seen[-2:]
    assert x <= 3 * a and y <= 3 * b
