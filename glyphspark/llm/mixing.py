"""Operator 10, mixing sources to target weights by hierarchical budgeting. Built-in functions only.

Contract of `mix`: the rows that the mixture takes, each once, with domain, n_tokens and epochs, the number of times that
it is taken (1 or more). Tokens are words between ASCII white space; a null text has none. The tree is domain, language,
source; the domain is the family of the source, its first FAMILY characters; a null lang or source counts as empty. The
budget is NUM / DEN of all tokens, at most what the leaves can give: a leaf gives its tokens EPOCHS times at most.

A node's budget goes to its children by weight (1 where none is given). A child that cannot give its share gives all it
has, and what is missing is shared among its siblings by their weights, again and again; only what all siblings
together lack would reach their parent, where it was shared among the parent's siblings before. Budgets are whole
numbers, rounded down at each node. A leaf takes whole epochs first and then a prefix of one more: rows in the order of
md5(seed:epoch:doc_id), each row for which the tokens of all rows before it are fewer than what is left. Repeated
doc_ids have equal places and go together. A leaf without tokens gives nothing.

Sizes: rows are read as (leaf, order key, tokens). The cut of a leaf is found from sums over fine ranges of the key, and
row by row only inside the one range where it falls, so a leaf with a third of all rows is no task of its own. The leaf
table is written to the shared folder; where its file is small, Spark broadcasts it. The one range of a leaf that is
cut row by row holds about ROWS_PER_RANGE rows, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, free

LEVELS = ("domain", "lang", "source")
FAMILY, SEED, EPOCHS, NUM, DEN = 4, 17, 4, 3, 4
#: Target weights by level; others weigh 1.
WEIGHTS = {"domain": {"src0": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {}}
ROWS_PER_RANGE = 4096


def _leaf() -> list[Column]:
    source = F.coalesce("source", F.lit(""))
    return [F.substring(source, 1, FAMILY), F.coalesce("lang", F.lit("")), source]


def _key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _weight(level: str, weights: dict) -> Column:
    given = weights.get(level) or {}
    w = F.lit(1)
    for name, v in given.items():
        w = F.when(F.col(level) == name, v).otherwise(w)
    return w.cast("long")


def share(nodes: DataFrame, parent: list[str], level: str, weights: dict) -> DataFrame:
    """Adds budget to nodes (parent..., level, cap, given): given, the parent's budget, is shared by weight under the caps.

    In the order of cap / weight the children that give all they have come first; the others share the rest."""
    w = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), level)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = nodes.withColumn("w", _weight(level, weights))
    df = df.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_w", F.sum("w").over(after))
    df = df.withColumn("all", F.col("cap") * F.col("left_w") <= F.col("w") * (F.col("given") - F.col("used")))
    whole = Window.partitionBy(*parent)
    df = df.withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("all"), F.col("cap"))).over(whole), F.lit(0))).withColumn("open_w", F.sum(F.when(~F.col("all"), F.col("w"))).over(whole))
    part = F.expr("(given - full_cap) * w div open_w")
    return df.withColumn("budget", F.when(F.col("all"), F.col("cap")).otherwise(part)).select(*parent, level, "cap", "budget")


def leaf_budgets(leaves: DataFrame, weights: dict = WEIGHTS, epochs: int = EPOCHS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(domain, lang, source, tokens, rows, budget) for leaves (domain, lang, source, tokens, rows)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(F.least(F.expr(f"sum(tokens) * {num} div {den}"), F.sum("cap")).cast("long").alias("given"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    top = share(domains.join(F.broadcast(total)).withColumn("root", F.lit(0)), ["root"], "domain", weights)  # one row
    mid = share(langs.join(top.select("domain", F.col("budget").alias("given")), "domain"), ["domain"], "lang", weights)
    low = share(leaves.join(mid.select("domain", "lang", F.col("budget").alias("given")), ["domain", "lang"]), ["domain", "lang"], "source", weights)
    return leaves.drop("cap").join(low.drop("cap"), list(LEVELS))


def leaf_cuts(docs: DataFrame, seed: int = SEED, weights: dict = WEIGHTS, epochs: int = EPOCHS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(domain, lang, source, whole, cut): whole epochs, and the last key that the next epoch takes, null for none."""
    light = durable(docs.select(*[c.alias(k) for k, c in zip(LEVELS, _leaf(), strict=True)], "doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n")), "mix-rows")
    leaves = light.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")).where("tokens > 0")
    plan = leaf_budgets(leaves, weights, epochs, num, den).withColumn("whole", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens"))
    plan = durable(plan.withColumn("ranges", F.ceil(F.col("rows") / ROWS_PER_RANGE)), "mix-plan")
    keyed = light.join(plan, list(LEVELS)).where("rest > 0").withColumn("key", _key(F.col("whole"), seed))
    keyed = keyed.withColumn("range", F.floor(F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / float(1 << 52) * F.col("ranges")))
    sums = keyed.groupBy(*LEVELS, "range").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).where("start < rest").groupBy(*LEVELS).agg(F.max_by("range", "range").alias("range"), F.max("start").alias("start"))
    edge = durable(edge, "mix-edges")
    inside = keyed.select(*LEVELS, "range", "key", "n", "rest").join(edge, [*LEVELS, "range"]).groupBy(*LEVELS, "key").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"), F.max("start").alias("start"))
    ahead = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.withColumn("sum", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where("start + sum < rest")
    cut = cut.groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    return durable(plan.join(cut, list(LEVELS), "left").select(*LEVELS, "whole", "cut"), "mix-cuts")


def mix(docs: DataFrame, seed: int = SEED, **plan) -> DataFrame:
    """docs' columns, then the domain and the epochs of the rows that are taken, called __domain and __epochs or, where docs
    has such columns, the same with more underscores; see the module's docstring."""
    names = free(docs.columns, "__domain", "__lang", "__source", "__whole", "__cut", "__epochs")
    *leaf, whole, cut, epochs = names
    cuts = leaf_cuts(docs, seed, **plan).toDF(*names[:5])
    taken = docs.select("*", *[c.alias(k) for k, c in zip(leaf, _leaf(), strict=True)]).join(cuts, leaf)
    again = F.coalesce(_key(F.col(whole), seed) <= F.col(cut), F.lit(False)).cast("long")
    return taken.withColumn(epochs, F.col(whole) + again).where(F.col(epochs) > 0).select(*docs.columns, leaf[0], epochs)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as it is taken, columns unchanged."""
    taken = mix(docs)
    copy = free(taken.columns, "__copy")[0]
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(taken.columns[-1])))).select(*docs.columns)


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, substr(coalesce(source, ''), 1, 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, 4 * sum(n)::BIGINT AS cap,
    1::BIGINT AS w FROM docs GROUP BY ALL HAVING sum(n) > 0),
langs AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::BIGINT AS w FROM leaves GROUP BY ALL),
domains AS (SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'src0' THEN 2 ELSE 1 END::BIGINT AS w FROM langs GROUP BY domain),
d1 AS (SELECT *, least((SELECT sum(tokens) * 3 // 4 FROM leaves), (SELECT sum(cap) FROM leaves))::BIGINT AS given FROM domains),
d2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM d1),
d3 AS (SELECT *, cap * left_w <= w * (given - used) AS done FROM d2),
d4 AS (SELECT domain, CASE WHEN done THEN cap ELSE (given - coalesce(sum(cap) FILTER (done) OVER (), 0)) * w // (sum(w) FILTER (NOT done) OVER ()) END AS given FROM d3),
l2 AS (SELECT l.*, given, coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM langs l JOIN d4 USING (domain)),
l3 AS (SELECT *, cap * left_w <= w * (given - used) AS done FROM l2),
l4 AS (SELECT domain, lang, CASE WHEN done THEN cap ELSE (given - coalesce(sum(cap) FILTER (done) OVER (PARTITION BY domain), 0)) * w // (sum(w) FILTER (NOT done) OVER (PARTITION BY domain)) END AS given FROM l3),
s2 AS (SELECT s.*, given, coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM leaves s JOIN l4 USING (domain, lang)),
s3 AS (SELECT *, cap * left_w <= w * (given - used) AS done FROM s2),
s4 AS (SELECT domain, lang, source, tokens, CASE WHEN done THEN cap ELSE (given - coalesce(sum(cap) FILTER (done) OVER (PARTITION BY domain, lang), 0)) * w // (sum(w) FILTER (NOT done) OVER (PARTITION BY domain, lang)) END AS budget FROM s3),
plan AS (SELECT *, budget // tokens AS whole, budget % tokens AS rest FROM s4),
keyed AS (SELECT d.*, whole, rest, md5('17:' || whole::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM docs d JOIN plan USING (domain, lang, source)),
ordered AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(n) OVER (PARTITION BY domain, lang, source, key) AS ahead FROM keyed)
SELECT doc_id, domain, lang, source, n AS n_tokens, (whole + CASE WHEN ahead < rest THEN 1 ELSE 0 END)::BIGINT AS epochs
FROM ordered WHERE whole + CASE WHEN ahead < rest THEN 1 ELSE 0 END > 0
"""
