"""Operator 5, quality rules with adaptive thresholds from mergeable quantile sketches. Built-in functions only.

Contract of `quality_verdicts`: every row comes back with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
base_failed and kept. Words are runs of characters other than space and U+0009 to U+000D; a null text has none.
word_chars counts code points in words; n_symbols characters of #*$%&|<>; n_dup_lines the lines (cut at line feeds) that
hold a word and equal an earlier line; n_repeat_words the words inside three-word windows that occur twice or more in the
text. base_failed: n_words < 50 or 100 * n_repeat_words > 50 * n_words. kept: false where base_failed, else whether every
signal lies inside the bounds of the row's language and source. A null lang or source is a group like any other. Repeated
rows are judged alike; extra columns are ignored; an empty table gives an empty result.

Signals: mean word length, symbols per word, share of repeated lines, share of repeated words. For each group a KLL
sketch of each signal is kept; groups with fewer than SMALL documents take the merged sketches of their language, and
languages below that those of all documents. A bound lies REACH times the distance from the median to the TAIL quantile
beyond that quantile, with at least the signal's FLOOR of room, so thresholds follow the group and clean documents stay.
Where a group's own tail is junk, that bound would follow the junk: it is no wider than both that of all documents and one
from the group's other side, REACH times the distance from the 1 - TAIL quantile to the median beyond the median.

n_repeat_words stays inside the row, without a shuffle: each window becomes a long of hash bits over the bits of its place
(PLACE of them, or as many as the longest place takes), the longs are sorted, and neighbours with equal hash bits are
compared word by word. A window whose neighbours have its bits but other words is held against all windows of its bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, durable

SMALL, TAIL, REACH, K = 200, 0.9, 4.0, 200
#: signal: (sides, least room beside the quantile)
SIGNALS = {"mean_word": ("both", 2.0), "symbol_rate": ("high", 0.1), "dup_line_rate": ("high", 0.4), "repeat_rate": ("high", 0.35)}
#: Bits of a place at least; the others hold a hash.
PLACE = 22


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _measure(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long"), "lang", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    df = df.select(
        "doc_id", "lang", "source",
        F.filter(F.split("text", SPACE + "+"), lambda x: x != "").alias("w"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("lines"),
    )
    n = F.size("w")
    df = df.withColumn("low", F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(PLACE), F.length(F.bin(n.cast("long"))))) - 1)
    low = F.col("low")
    window = lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2])
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    df = df.withColumn("key", F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<long>")))
    key = F.col("key")
    last = F.size(key) - 1

    def bits(x: Column, y: Column) -> Column:
        return F.coalesce(x.bitwiseAND(F.bitwise_not(low)) == y.bitwiseAND(F.bitwise_not(low)), F.lit(False))

    def same(x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
        return bits(x, y) & (F.col("w")[i] == F.col("w")[j]) & (F.col("w")[i + 1] == F.col("w")[j + 1]) & (F.col("w")[i + 2] == F.col("w")[j + 2])

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get(key, k - 1), F.get(key, k + 1)
        beside = ((k > 0) & same(x, before)) | ((k < last) & same(x, after))
        return beside | ((bits(x, before) | bits(x, after)) & F.exists(key, lambda y: (x != y) & same(x, y)))

    df = df.withColumn("at", F.sort_array(F.transform(F.filter(key, repeated), lambda x: x.bitwiseAND(low))))
    # windows cover three words each; a later one adds what the one before leaves
    covered = F.aggregate(F.col("at"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("p")), lambda s, p: F.struct((s["n"] + F.least(p - s["p"], F.lit(3).cast("long"))).alias("n"), p.alias("p")), lambda s: s["n"])
    return df.select("doc_id", "lang", "source", n.cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("lines.d").alias("n_dup_lines"), F.col("lines.n").alias("n_lines"), covered.alias("n_repeat_words"))


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, low_*, high_*) from the sketches of rows with the signals; one row for each group."""
    sketch = [F.kll_sketch_agg_double(s, F.lit(K)).alias(s) for s in SIGNALS]
    group = durable(measured.groupBy("lang", "source").agg(F.count("*").alias("n"), *sketch), "sketches")
    merge = [F.kll_merge_agg_double(s, F.lit(K)).alias(s) for s in SIGNALS]
    lang = group.groupBy("lang").agg(F.sum("n").alias("n"), *merge).select(F.col("lang").alias("l"), F.struct("n", *SIGNALS).alias("by_lang"))
    all_ = group.agg(F.sum("n").alias("n"), *merge).select(F.struct("n", *SIGNALS).alias("by_all"))
    own = group.select("lang", "source", F.struct("n", *SIGNALS).alias("own")).join(lang, F.col("lang").eqNullSafe(F.col("l"))).join(F.broadcast(all_))  # one row
    pick = F.when(F.col("own.n") >= SMALL, F.col("own")).when(F.col("by_lang.n") >= SMALL, F.col("by_lang")).otherwise(F.col("by_all"))
    own = own.select("lang", "source", pick.alias("q"), "by_all")
    out = []
    for s, (sides, floor) in SIGNALS.items():
        at = lambda p, q="q", s=s: F.kll_sketch_get_quantile_double(F.col(f"{q}.{s}"), F.lit(p))
        room = lambda d, floor=floor: F.greatest(d * REACH, F.lit(floor))
        high = lambda q, at=at, room=room: at(TAIL, q) + room(at(TAIL, q) - at(0.5, q))
        low = lambda q, at=at, room=room: at(1 - TAIL, q) - room(at(0.5, q) - at(1 - TAIL, q))
        mirror = at(0.5) + room(at(0.5) - at(1 - TAIL))
        out.append(F.least(high("q"), F.greatest(high("by_all"), mirror)).alias(f"high_{s}"))
        if sides == "both":
            mirror = at(0.5) - room(at(TAIL) - at(0.5))
            out.append(F.greatest(low("q"), F.least(low("by_all"), mirror)).alias(f"low_{s}"))
    return own.select("lang", "source", *out)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """See the module's docstring."""
    measured = durable(_measure(docs), "signals")
    words = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rated = measured.withColumns({
        "base_failed": failed, "mean_word": F.col("word_chars") / words, "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_rate": F.col("n_repeat_words") / words,
    })
    limits = thresholds(rated.where(~F.col("base_failed"))).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    fits = F.lit(True)
    for s, (sides, _) in SIGNALS.items():
        fits &= F.col(s) <= F.col(f"high_{s}")
        if sides == "both":
            fits &= F.col(s) >= F.col(f"low_{s}")
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(fits, F.lit(True))).alias("kept"))
