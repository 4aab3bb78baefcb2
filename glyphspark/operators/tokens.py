"""Tokens as rows: a table function, rules as a table, and what is unmapped in a whole corpus.

Rules are rows (encoding_id, ord, legacy, unicode, kind): those of the registered encodings, or a caller's own. Tokens meet
them by a broadcast join on encoding and legacy text; a table of more than MAX_RULES rules is refused.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..encodings import registry
from ..encodings.registry import Encoding
from ..encodings.rules import NONE
from . import transcode

MAX_RULES = 100_000
#: Rows of counts that a task gathers before they leave it, about.
BATCH_ROWS = 50_000
RULES = "encoding_id string, ord int, legacy string, unicode string, kind string"


def rules_table(spark: SparkSession, encodings: list[Encoding] | None = None) -> DataFrame:
    """Rules of encodings, the registered ones unless told otherwise."""
    rows = [(e.id, i, k, *rule) for i, e in enumerate(registry.listed() if encodings is None else encodings) for k, rule in e.rules.items()]
    return spark.createDataFrame(rows, RULES)


def encodings_of(rules: DataFrame) -> list[Encoding]:
    """Encodings of a rule table, in the order of ord; one of a registered id has that one's post-processing. Nulls of kind
    are none; rules without legacy text are left out. Two rules of one legacy text are an error."""
    rows = rules.select("encoding_id", "ord", "legacy", "unicode", F.coalesce("kind", F.lit(NONE))).where("legacy <> ''").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by: dict[tuple, dict] = {}
    for name, order, legacy, out, kind in rows:
        mine = by.setdefault((order, name), {})
        if legacy in mine:
            raise ValueError(f"two rules of {name} for {legacy!r}")
        mine[legacy] = (out or "", kind)
    known = lambda name: registry.get(name).post if registry.get(name) else None
    return [Encoding(name, name, mine, known(name)) for (_, name), mine in sorted(by.items(), key=lambda x: x[0])]


def tokens_udtf(encodings: list[Encoding]):
    """Table function (text, encoding_id) -> (pos, legacy): the tokens of a text by longest match, from 0. A null text or an
    unknown encoding has none."""
    patterns = {e.id: e.pattern for e in encodings}

    @F.udtf(returnType="pos int, legacy string")
    class Tokens:
        def eval(self, text: str, encoding_id: str):
            pattern = patterns.get(encoding_id)
            if text and pattern:
                for k, m in enumerate(pattern.finditer(text)):
                    yield k, m[0]

    return Tokens


def counts_udtf(encodings: list[Encoding]):
    """Table function (text, encoding_id) -> (legacy, n): the distinct tokens of a text, far fewer rows than its tokens."""
    patterns = {e.id: e.pattern for e in encodings}

    @F.udtf(returnType="legacy string, n long")
    class Counts:
        def eval(self, text: str, encoding_id: str):
            pattern = patterns.get(encoding_id)
            if text and pattern:
                yield from Counter(pattern.findall(text)).items()

    return Counts


def _with_rules(found: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """found (doc_id, encoding_id, legacy, ...) with what the rules say of its tokens."""
    joined = found.join(F.broadcast(rules.select("encoding_id", "legacy", F.coalesce("unicode", F.lit("")).alias("u"), F.coalesce("kind", F.lit(NONE)).alias("k"))), ["encoding_id", "legacy"], "left")
    shared = F.col("legacy").rlike(f"^(?:{transcode.SHARED})$")
    return joined.select("doc_id", "encoding_id", *columns, F.coalesce("u", "legacy").alias("unicode"), F.coalesce("k", F.lit(NONE)).alias("kind"), (F.col("u").isNotNull() | shared).alias("mapped"))


def token_rows(docs: DataFrame, rules: DataFrame, name: str = "glyph_tokens") -> DataFrame:
    """(doc_id, encoding_id, pos, legacy, unicode, kind, mapped) of docs (doc_id, text) under every encoding of rules, before
    post-processing. The table function is registered under name, for SQL: glyph_tokens(text, encoding_id)."""
    encodings = encodings_of(rules)
    made = tokens_udtf(encodings)
    docs.sparkSession.udtf.register(name, made)
    each = F.explode(F.array(*[F.lit(e.id) for e in encodings]).cast("array<string>"))
    pairs = docs.select("doc_id", "text", each.alias("encoding_id"))
    found = pairs.lateralJoin(made(F.col("text").outer(), F.col("encoding_id").outer())).select("doc_id", "encoding_id", "pos", "legacy")
    return _with_rules(found, rules, ["pos", "legacy"])


def counted_rows(docs: DataFrame, rules: DataFrame, name: str = "glyph_counts") -> DataFrame:
    """(doc_id, encoding_id, legacy, n, unicode, kind, mapped): the same by distinct tokens of each text, with counts; for all
    encodings in one pass over the characters. SQL has the table function counts_udtf under name."""
    encodings = encodings_of(rules)
    docs.sparkSession.udtf.register(name, counts_udtf(encodings))
    names = [e.id for e in encodings]

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), [[], [], [], []]
            fields = [ids.type, pa.string(), pa.string(), pa.int64()]
            flush = lambda rows: pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), *[pa.array(x, t) for x, t in zip(rows[1:], fields[1:], strict=True)]], names=["doc_id", "encoding_id", "legacy", "n"])
            for i, k, found in transcode.glyphs(encodings).distinct(batch.column(1).to_pylist()):
                for column, values in zip(rows, ([i] * len(found), [names[k]] * len(found), *zip(*found, strict=True)), strict=True):
                    column.extend(values)
                if len(rows[0]) >= BATCH_ROWS:
                    yield flush(rows)
                    rows = [[], [], [], []]
            yield flush(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, encoding_id string, legacy string, n long")
    return _with_rules(found, rules, ["legacy", "n"])


def _unmapped_parts(docs: DataFrame, encoding: Encoding) -> DataFrame:
    """(sequence, n, documents, contexts) of the texts of each task, contexts with doc_id and place, the first MAX_CONTEXTS."""
    most = transcode.MAX_CONTEXTS
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        made, seen, ids = transcode.rewriter(encoding), {}, None
        for batch in batches:
            ids = batch.column(0)
            names = ids.to_pylist()
            for x in made.lines(batch.column(1).to_pylist()):
                for k, row in enumerate(x.unmapped(most)):
                    doc = (names[x.first + k] is not None, names[x.first + k])
                    for t, n, near in row:
                        d = seen.setdefault(t, [0, 0, []])
                        d[0], d[1] = d[0] + n, d[1] + 1
                        if len(d[2]) < most or doc <= d[2][-1][0]:
                            new = [(doc, i, transcode.nfc(x.context(k, p, transcode.CONTEXT))) for i, p in enumerate(near)]
                            d[2] = sorted([*d[2], *new])[:most]
        if seen:
            inner = pa.struct([("doc_id", ids.type), ("pos", pa.int32()), ("context", pa.string())])
            contexts = [[{"doc_id": doc[1], "pos": i, "context": c} for doc, i, c in d[2]] for d in seen.values()]
            columns = [pa.array([made.name(t) for t in seen]), *[pa.array([d[k] for d in seen.values()], pa.int64()) for k in (0, 1)], pa.array(contexts, pa.list_(inner))]
            yield pa.RecordBatch.from_arrays(columns, names=["sequence", "n", "documents", "contexts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"sequence string, n long, documents long, contexts array<struct<doc_id:{kind},pos:int,context:string>>")


def unmapped_report(docs: DataFrame, encoding: Encoding) -> DataFrame:
    """(sequence, n, documents, contexts, line) of all texts of docs (doc_id, text): how often each unmapped sequence stands,
    in how many documents, its first contexts in the order of doc_id and place, and the line that a reader sees.

    A task brings one row for each sequence of its texts, with MAX_CONTEXTS contexts at most, so a sequence of every document
    costs no more than another and only contexts that may be among the first are made."""
    found = _unmapped_parts(docs, encoding).groupBy("sequence").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"), F.flatten(F.collect_list("contexts")).alias("c"))  # MAX_CONTEXTS of a task
    first = F.transform(F.slice(F.sort_array("c"), 1, transcode.MAX_CONTEXTS), lambda x: x["context"])
    line = F.concat(F.lit('"'), F.col("sequence"), F.lit('" ×'), F.col("n").cast("string"), F.lit(" — "), F.array_join("contexts", "  |  "))
    return found.select("sequence", "n", "documents", first.alias("contexts")).select("*", line.alias("line"))
