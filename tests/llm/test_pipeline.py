import os
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from test_operators import exhaustive_bm25, shingles

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_each_stage_takes_effect(spark):
    from glyphspark.llm import decontaminate, jaccard
    from glyphspark.llm.common import durable, table

    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, SF), name)
        if name != "sharding":
            assert docs.columns == columns
        seen.append(docs)
    assert jaccard.jaccard_components(seen[2]).where("component_id <> doc_id").count() == 0
    assert decontaminate.find_leaks(seen[3], table(spark, SF, "benchmark")).count() == 0
    assert decontaminate.find_leaks(seen[2], table(spark, SF, "benchmark")).select("doc_id").distinct().count() == seen[2].count() - seen[3].count()
    assert seen[5].count() == seen[4].count()
    assert {r.doc_id for r in seen[5].collect()} == {r.doc_id for r in seen[4].collect()}


def _linked(texts: list[str | None]) -> list[int]:
    """Group of each text by brute force: the first one that it reaches by links."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, a in enumerate(sets):
        for j in {j for g in a for j in where[g] if j < i}:
            both = len(a & sets[j])
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_each_stage_equals_brute_force(spark, tmp_path):
    from glyphspark.llm import langid, mixing
    from glyphspark.llm.common import durable, table

    docs = durable(table(spark, SF, "documents").unionByName(spark.createDataFrame([(None, "no language known here", None, None, 1), (10**9, None, None, None, 0), (10**9 + 1, " 12 !", None, None, 5)], table(spark, SF, "documents").schema)), "input")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, SF), name)
        seen.append(docs)
    rows = [sorted((tuple(r) for r in d.collect()), key=str) for d in seen]

    # 1: the rows whose verdict is not rejected; those without a letter go
    verdict = {r.doc_id: r.rejected for r in langid.identify(seen[0]).collect()}
    assert rows[1] == [r for r in rows[0] if not verdict[r[0]]] and not {10**9, 10**9 + 1} & {r[0] for r in rows[1]}
    # 2: one row of each group, the smallest doc_id
    texts = sorted(rows[1], key=lambda r: (r[0] is None, r[0] or 0))
    groups = _linked([r[1] for r in texts])
    assert rows[2] == sorted((r for i, r in enumerate(texts) if groups[i] == i), key=str)
    # 3: no row with an item at the threshold
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {d for d, _ in exhaustive_bm25([(i, r[1]) for i, r in enumerate(rows[2])], items)}
    assert bad and rows[3] == [r for i, r in enumerate(rows[2]) if i not in bad]
    # 4: as often as the SQL of the mixture says
    pq.write_table(seen[3].toArrow(), tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    epochs = {r[0]: r[-1] for r in db.execute(mixing.ORACLE_SQL).fetchall()}
    want = Counter({r: epochs[r[0]] for r in rows[3] if r[0] in epochs})
    assert Counter(rows[4]) == want
    # 5: each row in one place
    assert Counter(r[0] for r in rows[5]) == Counter(r[0] for r in rows[4])
