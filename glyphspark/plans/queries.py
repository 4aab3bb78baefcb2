"""Queries over the given tables, one or more for each operator, and DuckDB SQL for those that SQL can express.

The tier of a document or user follows its number. Doubles are rounded to six places on both sides. Queries over records
of activity are in records.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..encodings import registry, rules
from ..functions import text as tx
from ..operators import compare, tokens, transcode
from ..sources import documents
from ..streaming import limits
from . import activity as act
from . import records, stored


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents for row-local work: as the scan splits them, dealt over the cores only where it has fewer splits than cores."""
    df = _t(spark, d, "documents").select("doc_id", "text", "lang", "source")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, "doc_id")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.col("ts").alias("created_at"), "user_id", F.col("event_type").alias("kind"), "value", "props")


def _tier(c: str):
    return F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("expert")), (F.col(c) % 3 + 1).cast("int"))


def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", transcode.token_totals(F.col("text"), "bijoy").alias("t")).select("doc_id", "t.*")


def unmapped_top(spark, d):
    pairs = _docs(spark, d).select(F.explode(transcode.unmapped_counts(F.col("text"), "bijoy")).alias("sequence", "n"))
    return pairs.groupBy("sequence").agg(F.sum("n").alias("n"))


def _converted(spark, d, encoding):
    df = _docs(spark, d).select("doc_id", transcode.convert_column(F.col("text"), encoding, document=True, details=False).alias("c"))
    return df.select("doc_id", F.sha2("c.text", 256).alias("text_sha256"), F.length("c.text").cast("long").alias("n_chars"), "c.n_tokens", "c.n_unmapped", "c.n_moved", "c.valid", "c.error")


def convert_bijoy(spark, d):
    return _converted(spark, d, "bijoy")


def convert_sutonny(spark, d):
    return _converted(spark, d, "sutonny")


def convert_alpha_ansi(spark, d):
    return _converted(spark, d, "alpha-ansi")


#: Ends of words that get a reph, and letters that stand for signs typed ahead: the texts have none of either.
_TYPED = (r"([a-z])z([ .,])", "©", "xk", "†‡")


def convert_bijoy_signs(spark, d):
    """convert_bijoy of texts some of whose letters are rephs, signs typed ahead and hasants."""
    df = _docs(spark, d).select("doc_id", transcode.convert_column(F.translate(F.regexp_replace("text", _TYPED[0], f"$1{_TYPED[1]}$2"), *_TYPED[2:]), "bijoy", document=True, details=False).alias("c"))
    return df.select("doc_id", F.sha2("c.text", 256).alias("text_sha256"), F.length("c.text").cast("long").alias("n_chars"), "c.n_tokens", "c.n_unmapped", "c.n_moved", "c.valid", "c.error")


def _resolved(spark, d, choice):
    """Documents (doc_id, text, choice, encoding_id): detected where the choice is auto."""
    docs = _docs(spark, d).withColumn("choice", choice)
    return transcode.resolve(docs, transcode.detect(transcode.detect_scores(docs)))


def conversion_issues(spark, d):
    """Failures and warnings of the whole document pipeline: limit, detection, conversion by the encoding detected, unmapped characters."""
    docs = _docs(spark, d).withColumn("used", F.coalesce(tx.non_ws_chars(F.col("text")), F.lit(0))).withColumn("max", act.tier_limit(_tier("doc_id"), F.lit(None)))
    fits = docs.where("used <= max")
    done = fits.join(transcode.detect(transcode.detect_scores(fits)), "doc_id").select("doc_id", transcode.conversion_outcome(F.col("text"), F.col("encoding_id")).alias("c"))
    over = docs.where("used > max").select("doc_id", F.lit("limit_exceeded").alias("kind"), F.lit("error").alias("severity"), F.lit("LIMIT_EXCEEDED_ERROR").alias("code"), F.lit(0).cast("long").alias("n_samples"))
    found = done.select("doc_id", F.explode(transcode.issues(F.col("c"))).alias("i")).select("doc_id", "i.kind", "i.severity", "i.code", F.size("i.samples").cast("long").alias("n_samples"))
    return over.unionByName(found)


def resolve_encoding(spark, d):
    """Documents under a choice of encoding, an unknown one and a list of enabled ones: what is used, or why none is."""
    choice = F.element_at(F.array(*map(F.lit, ("auto", "bijoy", "klingon", "sutonny"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _resolved(spark, d, choice).select("doc_id", "choice", "encoding_id", transcode.refusal(F.col("encoding_id"), ["bijoy", "alpha-ansi"]).alias("error"))


def conversion_trace(spark, d):
    """Counts and previews of each stage of the conversion."""
    rows = _docs(spark, d).select("doc_id", transcode.trace(F.col("text"), "bijoy").alias("t"))
    return rows.select("doc_id", F.explode("t").alias("s")).select("doc_id", "s.stage", "s.n", F.array_join("s.preview", "|").alias("preview"))


def detect_scores(spark, d):
    s = transcode.detect_scores(_docs(spark, d))
    return s.select("doc_id", "encoding_id", F.round("confidence", 6).alias("confidence"), F.round("legacy_coverage", 6).alias("legacy_coverage"))


def detect_best(spark, d):
    return transcode.detect(transcode.detect_scores(_docs(spark, d))).select("doc_id", "encoding_id", F.round("confidence", 6).alias("confidence"))


def unicode_check(spark, d):
    return _docs(spark, d).select("doc_id", transcode.check_unicode(F.col("text")).alias("c")).select("doc_id", "c.*")


#: Letters that stand for signs in texts which have none: a vowel sign, a long one, an accent that composes, a nukta.
_SIGNS = ("kwyz", "\u09be\u09d7\u0301\u09bc")


def unicode_check_signs(spark, d):
    """unicode_check of texts some of whose letters are signs: stray ones, and letters that are not composed."""
    text = F.translate("text", *_SIGNS)
    return _docs(spark, d).select("doc_id", transcode.check_unicode(text).alias("c")).select("doc_id", "c.*")


_OWN = {chr(97 + k): chr(65 + k) for k in range(26)} | {"th": "Þ", "sch": "Š", "ch": "Ĉ", "ss": "ẞ", "qu": "Ɋ"}


def _own_encoding(spark):
    """An encoding as a caller adds it, as rows: small letters to capitals, a few runs of them to other letters."""
    return spark.createDataFrame([("own", 9, k, v, None) for k, v in _OWN.items()], tokens.RULES)


def token_kinds(spark, d):
    """Tokens of all documents under each registered encoding and one that is added as rows, by kind: in all, mapped, and the
    distinct ones."""
    rules = tokens.rules_table(spark).unionByName(_own_encoding(spark))
    rows = tokens.counted_rows(_docs(spark, d).select("doc_id", "text"), rules)
    light = rows.groupBy("encoding_id", "kind", "mapped", "legacy").agg(F.sum("n").alias("n"))
    return light.groupBy("encoding_id", "kind", "mapped").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_tokens"))


def unmapped_contexts(spark, d):
    """What the added encoding leaves unmapped in all documents, with its first contexts."""
    report = tokens.unmapped_report(_docs(spark, d), tokens.encodings_of(_own_encoding(spark))[0])
    return report.select("sequence", "n", "documents", "line")


def grapheme_counts(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(transcode.graphemes(F.col("text"))).cast("long").alias("n_graphemes"))


def headword(spark, d):
    """Of each text, read by its detected encoding or else the first one, the longest converted word that holds Bengali."""
    r = _resolved(spark, d, F.lit("auto"))
    rows = r.select("doc_id", transcode.specimen(F.col("text"), F.coalesce("encoding_id", F.lit(registry.listed()[0].id))).alias("s"))
    return rows.select("doc_id", "s.encoding_id", "s.headword", "s.legacy")


def text_measures(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", tx.non_ws_chars(t).alias("n_chars_no_ws"), tx.word_count(t).alias("n_words"), F.size(tx.paragraphs(t)).cast("long").alias("n_paragraphs"))


def usage_check(spark, d):
    df = _docs(spark, d).withColumn("used", tx.non_ws_chars(F.col("text"))).withColumn("tier", _tier("doc_id"))
    return df.select("doc_id", "tier", act.check_usage(F.col("used"), act.tier_limit(F.col("tier"), F.lit(None)), F.col("tier")).alias("u")).select("doc_id", "tier", "u.used", "u.max", "u.remaining", "u.within_limit", "u.message", "u.band")


def format_resolve(spark, d):
    return _t(spark, d, "pages").select("page_id", F.coalesce(tx.file_format(F.col("url"), F.lit("text/plain")), F.lit("none")).alias("format"))


def unreliable_text(spark, d):
    return _t(spark, d, "pages").select("page_id", F.round(tx.unreliable_ratio(F.col("html")), 6).alias("ratio"))


def extract_pages(spark, d):
    """Pages as files of several types, some empty, blank or too large: their text, or why there is none."""
    p, k = _t(spark, d, "pages"), F.col("page_id")
    name = F.concat(F.lit("page"), k.cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".TXT", ".docx", ".pdf", ".doc", ".exe"))), (k % 6 + 1).cast("int")))
    content = F.encode(F.when(k % 7 == 0, "").when(k % 7 == 1, " \n ").when(k % 7 == 2, F.concat(F.lit("\ufeff"), "html")).otherwise(F.col("html")), "UTF-8")
    files = p.select(k.cast("string").alias("path"), content.alias("content"), name.alias("file_name"), F.when(k % 4 == 1, "text/plain").alias("mime")).withColumn("length", F.octet_length("content").cast("long"))
    rows = documents.extract(files, 3000)
    return rows.select(F.col("path").cast("long").alias("page_id"), "file_type", F.sha2("text", 256).alias("text_sha256"), "error")


def _pairs(spark, d):
    """Adjacent documents of a source (doc_id, b, text, target). Both sides are dealt out by what they are joined on, into as
    many parts as the per-row work behind the join wants; the join adds no exchange of its own."""
    docs = _t(spark, d, "documents").select("doc_id", "source", "text")
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = docs.withColumn("b", F.col("doc_id") + 20).repartition(n, "b", "source")
    right = docs.select(F.col("doc_id").alias("b"), "source", F.col("text").alias("target")).repartition(n, "b", "source")
    return left.join(right, ["b", "source"])


def dice_adjacent(spark, d):
    pairs = _pairs(spark, d).select(F.col("doc_id").alias("a"), "b", F.round(compare.pair_similarity(F.col("text"), F.col("target")), 6).alias("similarity"))
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _turn_pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, d, "conversations").withColumn("source", F.lag("text").over(w)).where("source is not null")


def diff_turns(spark, d):
    """Word diff of each turn with the one before: both sides put together again, and how many tokens stayed or changed."""
    rows = _turn_pairs(spark, d).select("conv_id", "turn", compare.compare_columns(F.col("source"), F.col("text")).alias("r"))
    whole = lambda kind: F.sha2(F.array_join(F.transform(F.filter("r.segments", lambda s: s["kind"] != kind), lambda s: s["value"]), ""), 256)
    return rows.select("conv_id", "turn", whole("added").alias("source_sha256"), whole("removed").alias("target_sha256"), "r.equal_tokens", "r.removed_tokens", "r.added_tokens")


def comparison_gate(spark, d):
    """Why adjacent documents of a source are compared or not, by the tier of the first."""
    pairs = _pairs(spark, d).select(F.col("doc_id").alias("a"), "b", "text", "target")
    return pairs.select("a", "b", compare.gate(F.col("text"), F.col("target"), act.tier_limit(_tier("a"), F.lit(None))).alias("refused"))


def diff_statistics(spark, d):
    rows = _turn_pairs(spark, d).select("conv_id", "turn", compare.compare_columns(F.col("source"), F.col("text"), segments=False).alias("r"))
    return rows.select("conv_id", "turn", "r.modifications", "r.removals", "r.additions", "r.unchanged_words", "r.changed_words", "r.source_words", "r.target_words", compare.badges(F.col("r")).alias("b")).select("*", "b.*").drop("b")


def diff_paragraphs(spark, d):
    """Lines as paragraphs, adjacent documents of a source."""
    lines = lambda c: F.regexp_replace(c, "\n", "\n\n")
    pairs = _pairs(spark, d).select(F.col("doc_id").alias("a"), "b", "text", "target")
    rows = pairs.select("a", "b", compare.compare_columns(lines("text"), lines("target"), "paragraph", False).alias("r"))
    return rows.select("a", "b", "r.source_words", "r.target_words", "r.equal_tokens", "r.removed_tokens", "r.added_tokens")


def history_top20(spark, d):
    return act.newest(_facts(spark, d), 20, "user_id").select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


def totals_breakdown(spark, d):
    facts = _facts(spark, d).withColumn("tier", _tier("user_id"))
    return act.breakdown(facts, ["kind", "tier"], F.round(F.sum("value"), 2)).select("dimension", "value", "n", "total")


def limits_resolution(spark, d):
    c = _t(spark, d, "customer")
    callers = c.select(F.col("c_custkey").alias("caller_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("uid"))
    users = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("uid"), F.lower("c_mktsegment").alias("seg")).select("uid", F.when(F.col("seg") == "building", "expert").when(F.col("seg") == "machinery", "medium").otherwise("unknown").alias("tier"))
    own = _t(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("uid"), (F.col("s_suppkey") * 10).alias("max"))
    wide = spark.createDataFrame([("medium", 7777)], "tier string, max long")
    return act.resolve_limits(callers, users, own, wide).select("caller_id", "tier", "max")


def issue_dedupe(spark, d):
    return act.merge_issues(_facts(spark, d), act.issue_key("kind", "user_id")).select("issue_key", "occurrences", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def first_occurrence(spark, d):
    return act.first_occurrences(_facts(spark, d), act.issue_key("kind", "user_id")).select("issue_key", "event_id")


def rate_limited(spark, d):
    events = _t(spark, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return limits.rate_limit(events, 3, 6 * 3600.0).select("event_id", "allowed", "retry_after")


def encoding_series(spark, d):
    """Documents by detected encoding, 0 for those without any."""
    every = spark.createDataFrame([(e.id,) for e in registry.listed()], "encoding_id string")
    counts = transcode.detect(transcode.detect_scores(_docs(spark, d))).groupBy("encoding_id").agg(F.count("*").alias("n"))
    return every.join(counts, "encoding_id", "left").select("encoding_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def error_status(spark, d):
    code = F.element_at(F.array(*map(F.lit, [*act.STATUS, "OTHER"])), (F.col("event_id") % (len(act.STATUS) + 1) + 1).cast("int"))
    return _facts(spark, d).select(act.http_status(code).cast("long").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


ALL = (
    token_counts, unmapped_top, convert_bijoy, convert_bijoy_signs, convert_sutonny, convert_alpha_ansi, conversion_issues, resolve_encoding, conversion_trace, detect_scores, detect_best, unicode_check, unicode_check_signs, token_kinds, unmapped_contexts, grapheme_counts, headword, text_measures, usage_check,
    format_resolve, unreliable_text, extract_pages, dice_adjacent, diff_turns, diff_statistics, diff_paragraphs, comparison_gate, history_top20, totals_breakdown, limits_resolution, issue_dedupe, first_occurrence, rate_limited, encoding_series, error_status,
)
QUERIES = {f.__name__: f for f in ALL} | records.QUERIES | stored.QUERIES

_LIMIT = "CASE doc_id % 3 WHEN 0 THEN 3000 WHEN 1 THEN 6000 ELSE 25000 END"
_TIER = "CASE {} % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'expert' END"


def _quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


#: White space and punctuation that pass through, for SQL lists.
_PASS = "\t\n\x0b\f\r .,;:!?'\"()[]{}-/% ‐‑‒–—―‘’“”…"
_BLANK = "\t\n\x0b\f\r  "


def _tokens(encoding: str | registry.Encoding) -> str:
    """DuckDB expression for the list of tokens."""
    e = registry.get(encoding) if isinstance(encoding, str) else encoding
    special = set("\\.^$|?*+()[]{}-&~#")
    many = sorted((k for k in e.rules if len(k) > 1), key=lambda k: (-len(k), k))
    pattern = "|".join(["".join("\\" + c if c in special and c not in "&~#" else c for c in k) for k in many] + ["(?s:.)"])
    return f"regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _scores_sql() -> str:
    parts = []
    for i, e in enumerate(registry.listed()):
        parts.append(f"SELECT doc_id, '{e.id}' AS encoding_id, {i} AS ord, list_filter({_tokens(e.id)}, lambda x: NOT list_contains([{_quoted(_BLANK)}], x)) AS tok, [{_quoted([*e.rules, *_PASS])}] AS good FROM documents")
    return f"""
WITH t AS ({' UNION ALL '.join(parts)}),
c AS (SELECT doc_id, encoding_id, ord, len(tok) AS total, len(list_filter(tok, lambda x: list_contains(good, x))) AS ok,
  list_filter(tok, lambda x: regexp_matches(x, '[^\\x00-\\x7F]')) AS far, good FROM t),
f AS (SELECT *, list_sum(list_transform(far, lambda x: len(regexp_extract_all(x, '[^\\x00-\\x7F]')))) AS n_far,
  coalesce(list_sum(list_transform(list_filter(far, lambda x: list_contains(good, x)), lambda x: len(regexp_extract_all(x, '[^\\x00-\\x7F]')))), 0) AS ok_far FROM c),
s AS (SELECT doc_id, encoding_id, ord, CASE WHEN coalesce(n_far, 0) = 0 THEN 1.0::DOUBLE ELSE ok_far / n_far END AS legacy, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE ok / total END AS cover FROM f),
scores AS (SELECT doc_id, encoding_id, ord, least(cover, legacy) AS confidence, legacy FROM s)
"""


#: Fixed values in DuckDB's patterns: hasant, the vowel signs that an alpha-ansi post-process moves, pairs that keep a hasant visible.
_HASANT, _VOWELS = "্", "ুূৃ"


def _converted_sql(encoding_id: str, keep: str = "") -> str:
    """CTEs up to done(doc_id, text, out, n_tokens, n_unmapped, n_moved): the conversion on a string in which each token is
    U+001E, its class (p sign ahead, r reph, h hasant, j joined, x other), what it reads as, U+001F."""
    e = registry.get(encoding_id)
    letter = {rules.PRE: "p", rules.REPH: "r"}
    pairs = [(k, letter.get(kind, "x") + out) for k, (out, kind) in e.rules.items()]
    table = f"MAP {{{', '.join(f'{_quoted([k])}: {_quoted([v])}' for k, v in pairs)}}}"
    token, steps = r"\x1E{}[^\x1F]*\x1F", ["array_to_string(list_transform(tok, lambda x: chr(30) || coalesce(rules[x], 'x' || x) || chr(31)), '')"]
    swap = lambda pattern, to: steps.append((pattern, to))
    if e.post is registry.bijoy_post:
        for a, b in sorted(registry.VISIBLE):
            swap(rf"(\x1E.{a}\x1F(?:\x1Ep[^\x1F]*\x1F)*\x1E.){_HASANT}(\x1F(?:\x1Ep[^\x1F]*\x1F)*\x1E.{b}\x1F)", rf"\1{_HASANT}{registry.ZWNJ}\2")
        # what a token ends with is marked ahead of the collapse, as a hasant that goes still counts for the next one
        swap(rf"{_HASANT}\x1F", f"{_HASANT}\x1d\x1f")
        swap(rf"(\x1D\x1F\x1E.){_HASANT}", r"\1")
        swap(r"\x1D", "")
    elif e.post:
        swap(rf"(\x1E.[{_VOWELS}]\x1F)((?:\x1E.{_HASANT}[^\x1F]*\x1F)+)", r"\2\1")
    swap(rf"\x1Ex({_HASANT}+\x1F)", "\x1eh\\1")
    swap(rf"\x1Ex({_HASANT})", "\x1ej\\1")
    swap(rf"((?:{token.format('p')})+)({token.format('[^pr]')}(?:{token.format('j')}|{token.format('h')}{token.format('.')})*)", r"\2\1")
    signs = r"\x1E.[\x{09BE}-\x{09CC}\x{09D7}\x{0981}-\x{0983}]+\x1F"
    swap(rf"((?:{token.format('.')}{token.format('h')})*{token.format('.')}(?:{token.format('j')})*(?:{signs})*)((?:{token.format('r')})+)", r"\2\1")
    before, after = steps[0], "before"
    for pattern, to in steps[1:-2]:
        before = f"regexp_replace({before}, '{pattern}', '{to}', 'g')"
    for pattern, to in steps[-2:]:
        after = f"regexp_replace({after}, '{pattern}', '{to}', 'g')"
    good = f"[{_quoted([*e.rules, *_PASS])}]"
    return f"""
c1 AS (SELECT doc_id, text, {_tokens(encoding_id)} AS tok, {table} AS rules FROM documents{keep}),
c2 AS (SELECT doc_id, text, len(tok)::BIGINT AS n_tokens, len(list_filter(tok, lambda x: NOT list_contains({good}, x)))::BIGINT AS n_unmapped, tok, {good} AS good, {before} AS before FROM c1),
c3 AS (SELECT *, {after} AS s FROM c2),
done AS (SELECT doc_id, text, tok, good, before, s, n_tokens, n_unmapped, len(regexp_extract_all(s, '\x1E[pr]'))::BIGINT AS n_moved, nfc_normalize(regexp_replace(s, '\x1E.|\x1F', '', 'g')) AS out FROM c3)
"""


def _convert_sql(encoding_id: str) -> str:
    blank = r"NOT regexp_matches(coalesce(text, ''), '[^\s\x0B]')"
    value = lambda x, other: f"CASE WHEN {blank} THEN {other} ELSE {x} END"
    return f"WITH {_converted_sql(encoding_id)} SELECT doc_id, {value('sha256(out)', 'NULL')} AS text_sha256, {value('length(out)::BIGINT', 'NULL')} AS n_chars, {value('n_tokens', 0)} AS n_tokens, {value('n_unmapped', 0)} AS n_unmapped, {value('n_moved', 0)} AS n_moved, {value('n_unmapped = 0', 'false')} AS valid, {value('NULL', chr(39) + 'FILE_PROCESSING_ERROR' + chr(39))} AS error FROM done"


_BEST = ", best AS (SELECT doc_id, confidence, CASE WHEN confidence >= 0.6 THEN encoding_id END AS encoding_id FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ord) = 1) "

#: The longest word with Bengali, or the first word, and the legacy word at its place.
_HEADWORD = ", ".join(_converted_sql(e.id, f" WHERE doc_id IN (SELECT doc_id FROM best WHERE coalesce(encoding_id, 'bijoy') = '{e.id}')").replace("c1", f"c1{i}").replace("c2", f"c2{i}").replace("c3", f"c3{i}").replace("done", f"done{i}") for i, e in enumerate(registry.listed())) + ", every AS (" + " UNION ALL ".join(f"SELECT doc_id, text, out, '{e.id}' AS encoding_id FROM done{i}" for i, e in enumerate(registry.listed())) + r"""),
w AS (SELECT doc_id, encoding_id, regexp_extract_all(out, '[^\s\x0B]+') AS w, regexp_extract_all(text, '[^\s\x0B]+') AS l FROM every),
u AS (SELECT doc_id, encoding_id, l, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
b AS (SELECT *, regexp_matches(word, '[\x{0980}-\x{09FF}]') AS bengali FROM u)
SELECT doc_id, encoding_id, word AS headword, coalesce(l[pos], '') AS legacy FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY bengali DESC, CASE WHEN bengali THEN -length(word) ELSE 0 END, pos) = 1"""

_ISSUES = rf""", u AS (SELECT doc_id, length(regexp_replace(text, '[\s\x0B]+', '', 'g'))::BIGINT AS used, ({_LIMIT})::BIGINT AS max FROM documents),
t AS (SELECT doc_id, encoding_id, list_distinct(list_filter(tok, lambda x: NOT list_contains(good, x))) AS bad FROM t)
SELECT doc_id, 'limit_exceeded' AS kind, 'error' AS severity, 'LIMIT_EXCEEDED_ERROR' AS code, 0::BIGINT AS n_samples FROM u WHERE used > max
UNION ALL SELECT doc_id, 'conversion_failed', 'error', 'VALIDATION_ERROR', 0 FROM u JOIN best USING (doc_id) WHERE used <= max AND encoding_id IS NULL
UNION ALL SELECT doc_id, 'unmapped_character', 'warning', 'UNMAPPED_CHARACTER', least(len(bad), 20)::BIGINT FROM u JOIN best USING (doc_id) JOIN unmapped USING (doc_id, encoding_id) WHERE used <= max AND len(bad) > 0""".replace("t AS (SELECT doc_id, encoding_id, list_distinct", "unmapped AS (SELECT doc_id, encoding_id, list_distinct")

#: A window starts with a key's first event, and again with its first event after a window's end.
_RATES = """
WITH RECURSIVE e AS (SELECT user_id AS key, ts, event_id FROM events),
starts AS (SELECT key, min(ts) AS start FROM e GROUP BY key UNION ALL SELECT s.key, min(e.ts) FROM starts s JOIN e ON e.key = s.key AND e.ts >= s.start + INTERVAL 6 HOUR GROUP BY s.key),
placed AS (SELECT e.*, max(start) AS start FROM e JOIN starts s ON s.key = e.key AND s.start <= e.ts GROUP BY e.key, e.ts, e.event_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key, start ORDER BY ts, event_id) AS n FROM placed)
SELECT event_id, n <= 3 AS allowed, CASE WHEN n <= 3 THEN 0 ELSE greatest(1, ceil((epoch_us(start) + 21600000000 - epoch_us(ts)) / 1000000.0)) END::BIGINT AS retry_after FROM ranked"""

def _common_sql(pairs: str) -> str:
    """CTEs from pairs (id, a, b of lists) up to m (id, n): the length of the longest common subsequence, one value of a at a
    time, as the best of a prefix of b is a running maximum."""
    return rf"""{pairs},
w AS (SELECT id, 0 AS side, unnest(a) AS word, generate_subscripts(a, 1) AS k FROM t UNION ALL SELECT id, 1, unnest(b), generate_subscripts(b, 1) FROM t),
c AS MATERIALIZED (SELECT id::INTEGER AS id, side, k::INTEGER AS k, dense_rank() OVER (ORDER BY word)::INTEGER AS word FROM w),
l AS (SELECT id, k AS j, word, 0 AS i, 0 AS n FROM c WHERE side = 1
  UNION ALL
  SELECT l.id, j, l.word, i + 1, max(CASE WHEN x.word = l.word THEN before + 1 ELSE n END) OVER (PARTITION BY l.id ORDER BY j)
  FROM (SELECT *, coalesce(lag(n) OVER (PARTITION BY id ORDER BY j), 0) AS before FROM l) l JOIN c x ON x.side = 0 AND x.id = l.id AND x.k = i + 1),
m AS (SELECT id, max(n) AS n FROM l GROUP BY id)"""


_COUNTS = "coalesce(n, 0)::BIGINT AS equal_tokens, len(a) - coalesce(n, 0)::BIGINT AS removed_tokens, len(b) - coalesce(n, 0)::BIGINT AS added_tokens FROM t LEFT JOIN m USING (id)"
_SPLIT = r"'[\s\x0B]+|[\pL\pN\pM_\x{200C}\x{200D}]+|(?s:.)'"
_DIFF = "WITH RECURSIVE " + _common_sql(rf"p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations), t AS (SELECT row_number() OVER () AS id, conv_id, turn, source, text, regexp_extract_all(source, {_SPLIT}) AS a, regexp_extract_all(text, {_SPLIT}) AS b FROM p WHERE source IS NOT NULL)") + f" SELECT conv_id, turn, sha256(source) AS source_sha256, sha256(text) AS target_sha256, {_COUNTS}"
_LINES = r"list_filter(list_transform(string_split(coalesce({}, ''), chr(10)), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '')"
_PARAGRAPHS = "WITH RECURSIVE " + _common_sql(f"t AS (SELECT row_number() OVER () AS id, x.doc_id AS p, y.doc_id AS q, x.text AS source, y.text AS target, {_LINES.format('x.text')} AS a, {_LINES.format('y.text')} AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 20 AND x.source = y.source)") + rf" SELECT p AS a, q AS b, len(regexp_extract_all(coalesce(source, ''), '[^\s\x0B]+'))::BIGINT AS source_words, len(regexp_extract_all(coalesce(target, ''), '[^\s\x0B]+'))::BIGINT AS target_words, {_COUNTS}"
_TRACE = rf"""
WITH {_converted_sql('bijoy')},
k AS (SELECT *, list_filter(tok, lambda x: regexp_matches(x, '[^\s\x0B]')) AS solid, list_filter(tok, lambda x: NOT list_contains(good, x)) AS bad FROM done),
first AS (SELECT doc_id, list_distinct(bad) AS every, list_transform(list_sort(list_transform(list_distinct(bad), lambda x: {{'at': list_position(bad, x), 'x': x}})), lambda r: r.x) AS unmapped FROM k),
shown AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(before, '\x1E.([^\x1F]*)\x1F', 1), lambda x: x = '' OR regexp_matches(x, '[^\s\x0B]'))[1:9], lambda x: CASE WHEN x = '' THEN '·' ELSE x END) AS b, list_transform(list_filter(regexp_extract_all(s, '\x1E.([^\x1F]*)\x1F', 1), lambda x: x = '' OR regexp_matches(x, '[^\s\x0B]'))[1:9], lambda x: CASE WHEN x = '' THEN '·' ELSE x END) AS p FROM k)
SELECT doc_id, 'tokenize' AS stage, len(solid)::BIGINT AS n, array_to_string(solid[1:9], '|') AS preview FROM k
UNION ALL SELECT doc_id, 'map', n_unmapped, array_to_string(b, '|') FROM k JOIN shown USING (doc_id)
UNION ALL SELECT doc_id, 'reorder', n_moved, array_to_string(p, '|') FROM k JOIN shown USING (doc_id)
UNION ALL SELECT doc_id, 'assemble', length(out)::BIGINT, substr(out, 1, 48) FROM k
UNION ALL SELECT doc_id, 'validate', len(unmapped)::BIGINT, CASE WHEN len(unmapped) = 0 THEN 'clean' ELSE array_to_string(unmapped[1:9], '|') END FROM first"""


_OWN_ENCODING = registry.Encoding("own", "own", {k: (v, rules.NONE) for k, v in _OWN.items()})
_KINDS = f"""
WITH t AS ({' UNION ALL '.join(f"SELECT '{e.id}' AS encoding_id, unnest({_tokens(e)}) AS x FROM documents" for e in [*registry.listed(), _OWN_ENCODING])}),
r AS (SELECT * FROM (VALUES {', '.join(f"('{e.id}', {_quoted([k])}, '{kind}')" for e in [*registry.listed(), _OWN_ENCODING] for k, (_, kind) in e.rules.items())}) v(encoding_id, x, kind)),
g AS (SELECT encoding_id, x, count(*) AS n FROM t GROUP BY ALL)
SELECT encoding_id, coalesce(kind, 'none') AS kind, kind IS NOT NULL OR list_contains([{_quoted(_PASS)}], x) AS mapped, sum(n)::BIGINT AS n, count(*) AS distinct_tokens FROM g LEFT JOIN r USING (encoding_id, x) GROUP BY ALL
"""
_CONTEXTS = f"""
WITH t AS (SELECT doc_id, {_tokens(_OWN_ENCODING)} AS tok, [{_quoted([*_OWN, *_PASS])}] AS good, MAP {{{', '.join(f'{_quoted([k])}: {_quoted([v])}' for k, v in _OWN.items())}}} AS reads FROM documents),
u AS (SELECT doc_id, unnest(list_filter(list_transform(range(1, len(tok) + 1), lambda i: {{'i': i, 'x': tok[i]}}), lambda p: NOT list_contains(good, p.x))) AS p FROM t),
n AS (SELECT p.x AS x, count(*) AS n, count(DISTINCT doc_id) AS documents FROM u GROUP BY 1),
f AS (SELECT doc_id, p.i AS i, p.x AS x, row_number() OVER (PARTITION BY p.x ORDER BY doc_id, p.i) AS rank FROM u QUALIFY rank <= 3),
c AS (SELECT x, rank, nfc_normalize((CASE WHEN i > 9 THEN '…' ELSE '' END) || array_to_string(list_transform(tok[greatest(i - 8, 1):i - 1], lambda y: coalesce(reads[y], y)), '') || '⟦' || x || '⟧'
  || array_to_string(list_transform(tok[i + 1:i + 8], lambda y: coalesce(reads[y], y)), '') || (CASE WHEN i + 8 < len(tok) THEN '…' ELSE '' END)) AS context FROM f JOIN t USING (doc_id))
SELECT x AS sequence, n.n AS n, n.documents AS documents, '"' || x || '" ×' || n.n || ' — ' || string_agg(context, '  |  ' ORDER BY rank) AS line FROM c JOIN n USING (x) GROUP BY x, n.n, n.documents
"""
ORACLE_SQL = {
    "token_counts": f"WITH t AS (SELECT doc_id, {_tokens('bijoy')} AS tok FROM documents), c AS (SELECT doc_id, len(tok)::BIGINT AS n, len(list_filter(tok, lambda x: list_contains([{_quoted([*registry.get('bijoy').rules, *_PASS])}], x)))::BIGINT AS good FROM t) SELECT doc_id, n AS n_tokens, good AS n_mapped, n - good AS n_unmapped FROM c",
    "unmapped_top": f"WITH t AS (SELECT unnest({_tokens('bijoy')}) AS sequence FROM documents) SELECT sequence, count(*) AS n FROM t WHERE NOT list_contains([{_quoted([*registry.get('bijoy').rules, *_PASS])}], sequence) GROUP BY sequence",
    "detect_scores": _scores_sql() + "SELECT doc_id, encoding_id, round(confidence, 6) AS confidence, round(legacy, 6) AS legacy_coverage FROM scores",
    "detect_best": _scores_sql() + _BEST + "SELECT doc_id, encoding_id, round(confidence, 6) AS confidence FROM best",
    "encoding_series": _scores_sql() + _BEST + f"SELECT e AS encoding_id, count(doc_id) AS n FROM (SELECT unnest([{_quoted(x.id for x in registry.listed())}]) AS e) LEFT JOIN best ON e = encoding_id GROUP BY e",
    "unicode_check": r"SELECT doc_id, text = nfc_normalize(text) AS is_nfc, regexp_matches(text, '(^|\s)[\x{09BE}-\x{09CC}\x{09D7}]') AS has_stray_sign FROM documents",
    **{f"convert_{e.id.replace('-', '_')}": _convert_sql(e.id) for e in registry.listed()},
    "headword": _scores_sql() + _BEST + ", " + _HEADWORD,
    "conversion_issues": _scores_sql() + _BEST + _ISSUES,
    "resolve_encoding": _scores_sql() + _BEST + "SELECT d.doc_id, choice, CASE choice WHEN 'auto' THEN encoding_id WHEN 'klingon' THEN NULL ELSE choice END AS encoding_id, CASE WHEN choice = 'klingon' OR choice = 'auto' AND encoding_id IS NULL THEN 'undetermined' WHEN CASE choice WHEN 'auto' THEN encoding_id ELSE choice END NOT IN ('bijoy', 'alpha-ansi') THEN 'disabled' END AS error FROM (SELECT doc_id, ['auto', 'bijoy', 'klingon', 'sutonny'][doc_id % 4 + 1] AS choice FROM documents) d JOIN best USING (doc_id)",
    "comparison_gate": rf"WITH u AS (SELECT doc_id, source, length(regexp_replace(coalesce(text, ''), '[\s\x0B]+', '', 'g')) AS n FROM documents) SELECT x.doc_id AS a, y.doc_id AS b, CASE WHEN least(x.n, y.n) = 0 THEN 'blank' WHEN greatest(x.n, y.n) > {_LIMIT.replace('doc_id', 'x.doc_id')} THEN 'over_limit' END AS refused FROM u x JOIN u y ON y.doc_id = x.doc_id + 20 AND x.source = y.source",
    "rate_limited": _RATES,
    "text_measures": r"SELECT doc_id, length(regexp_replace(text, '[\s\x0B]+', '', 'g'))::BIGINT AS n_chars_no_ws, len(regexp_extract_all(text, '[^\s\x0B]+'))::BIGINT AS n_words, len(list_filter(regexp_split_to_array(text, '\r?\n[\s\x0B]*\r?\n'), lambda x: regexp_matches(x, '[^\s\x0B]')))::BIGINT AS n_paragraphs FROM documents",
    "usage_check": rf"WITH u AS (SELECT doc_id, {_TIER.format('doc_id')} AS tier, length(regexp_replace(text, '[\s\x0B]+', '', 'g'))::BIGINT AS used, ({_LIMIT})::BIGINT AS max FROM documents) SELECT *, greatest(max - used, 0)::BIGINT AS remaining, used <= max AS within_limit, CASE WHEN used > max THEN 'This input has ' || format('{{:,}}', used) || ' characters, which exceeds the ' || tier || ' tier limit of ' || format('{{:,}}', max) || '. Reduce the input or use a higher tier.' END AS message, CASE WHEN used > max THEN 'danger' WHEN used / max > 0.85 THEN 'warning' ELSE 'ok' END AS band FROM u",
    "format_resolve": "SELECT page_id, CASE WHEN lower(list_last(string_split(url, '.'))) IN ('txt', 'pdf', 'doc', 'docx') THEN lower(list_last(string_split(url, '.'))) ELSE 'txt' END AS format FROM pages",
    "unreliable_text": r"SELECT page_id, CASE WHEN length(html) > 0 THEN round(len(regexp_extract_all(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]')) / length(html), 6) ELSE 0.0 END AS ratio FROM pages",
    "extract_pages": r"WITH f AS (SELECT page_id, ['.txt', '.TXT', '.docx', '.pdf', '.doc', '.exe'][page_id % 6 + 1] AS suffix, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) || ' ' WHEN 2 THEN chr(65279) || html ELSE html END AS body, html FROM pages), k AS (SELECT *, coalesce(CASE WHEN lower(suffix) <> '.exe' THEN lower(suffix[2:]) END, CASE WHEN page_id % 4 = 1 THEN 'txt' END) AS file_type, CASE WHEN page_id % 7 = 2 THEN html ELSE body END AS plain FROM f), e AS (SELECT *, CASE WHEN body = '' THEN 'empty' WHEN strlen(body) > 3000 THEN 'too_large' WHEN file_type IS NULL THEN 'unsupported' WHEN file_type = 'docx' THEN 'corrupted' WHEN file_type <> 'txt' THEN 'extraction_failed' WHEN NOT regexp_matches(plain, '[^\s\x0B]') THEN 'empty' END AS error FROM k) SELECT page_id, file_type, CASE WHEN error IS NULL THEN sha256(plain) END AS text_sha256, error FROM e",
    "dice_adjacent": r"WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[^\s\x0B]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id), p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 20 AND x.source = y.source), m AS (SELECT a, b, sum(least(x.n, y.n)) AS both_n FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b AND y.w = x.w GROUP BY a, b) SELECT p.a, p.b, round(CASE WHEN coalesce(s1.n, 0) + coalesce(s2.n, 0) = 0 THEN 1.0 ELSE 2 * coalesce(both_n, 0) / (coalesce(s1.n, 0) + coalesce(s2.n, 0)) END, 6) AS similarity FROM p LEFT JOIN m USING (a, b) LEFT JOIN s s1 ON s1.doc_id = p.a LEFT JOIN s s2 ON s2.doc_id = p.b",
    "diff_turns": _DIFF,
    "diff_paragraphs": _PARAGRAPHS,
    "conversion_trace": _TRACE,
    "unicode_check_signs": f"WITH t AS (SELECT doc_id, translate(text, '{_SIGNS[0]}', '{_SIGNS[1]}') AS text FROM documents) SELECT doc_id, coalesce(nfc_normalize(text) = text, true) AS is_nfc, coalesce(regexp_matches(text, '(^|[ \\t\\n\\x0B\\f\\r])[\u09be-\u09cc\u09d7]'), false) AS has_stray_sign FROM t",
    "convert_bijoy_signs": _convert_sql("bijoy").replace("FROM documents", rf"FROM (SELECT doc_id, translate(regexp_replace(text, '{_TYPED[0]}', '\1{_TYPED[1]}\2', 'g'), '{_TYPED[2]}', '{_TYPED[3]}') AS text FROM documents)"),
    "token_kinds": _KINDS, "unmapped_contexts": _CONTEXTS,
    "grapheme_counts": "SELECT conv_id, turn, length_grapheme(text)::BIGINT AS n_graphemes FROM conversations",
    "history_top20": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 20",
    "totals_breakdown": f"WITH e AS (SELECT event_type AS kind, {_TIER.format('user_id')} AS tier, value AS v FROM events) SELECT 'kind' AS dimension, kind AS value, count(*) AS n, round(sum(v), 2) AS total FROM e GROUP BY kind UNION ALL SELECT 'tier', tier, count(*), round(sum(v), 2) FROM e GROUP BY tier",
    "limits_resolution": "WITH c AS (SELECT c_custkey AS caller_id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS uid FROM customer), u AS (SELECT c_custkey AS uid, CASE lower(c_mktsegment) WHEN 'building' THEN 'expert' WHEN 'machinery' THEN 'medium' ELSE 'easy' END AS tier FROM customer WHERE c_custkey % 5 <> 0), j AS (SELECT caller_id, c.uid, coalesce(tier, 'easy') AS tier, s_suppkey * 10 AS own FROM c LEFT JOIN u ON u.uid = c.uid LEFT JOIN supplier ON s_suppkey * 3 = c.uid) SELECT caller_id, tier, coalesce(CASE WHEN uid IS NOT NULL THEN coalesce(own, CASE WHEN tier = 'medium' THEN 7777 END) END, CASE tier WHEN 'easy' THEN 3000 WHEN 'medium' THEN 6000 ELSE 25000 END)::BIGINT AS max FROM j",
    "issue_dedupe": "SELECT event_type || '|' || user_id AS issue_key, count(*) AS occurrences, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1",
    "first_occurrence": "SELECT event_type || '|' || user_id AS issue_key, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1",
    "error_status": "SELECT [400, 422, 422, 413, 401, 403, 429, 500, 500, 500, 500][event_id % 11 + 1]::BIGINT AS status, count(*) AS n FROM events GROUP BY 1",
} | records.ORACLE_SQL | stored.ORACLE_SQL
