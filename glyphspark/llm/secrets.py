r"""Operator 1, secret scans: base patterns, and random-looking runs found by a randomness test battery. Built-in functions only.

Contract of `scan`: every row comes back with n_assign, n_access, n_hex, base_sha256, spans and n_random. A null text
counts as empty. Base spans are leftmost, without overlap within a kind: assign (a key word, an optional quote, : or =,
a value of 8 characters or more), access (AKIA and more, 16 characters or more), hex (32 or more of 0-9a-f). Matches that
are too short are dropped after matching. spans holds kind:start:end in code points by start, then kind (assign, access,
hex, random); base_sha256 is the digest of the base ones alone. Repeated rows are scanned alike, extra columns ignored.

random spans: each maximal run of 20 or more of [A-Za-z0-9+/_=-] that meets no base span is a candidate. Its encoding is
inferred from the characters present (hex, base32, base36, letters, base62, base64), trailing = aside. Three tests ask
whether it could be uniform over that alphabet: chi-squared on symbol counts, runs of the upper and lower half of the
alphabet, lag-one serial correlation of symbol values (16 levels). The battery rejects a candidate whose smallest
p-value times three is under BATTERY. The rest must be a discovery against ordinary text: the same chi-squared
statistic's lower tail where symbols repeat as in text (index of coincidence TEXT_IC), which grows apart with the length
of the run. Benjamini-Hochberg at level Q is applied within each stratum of encoding and length, over all candidates of
the whole table, from a histogram of p-values (tenths of a decade, rounded so that none looks smaller than it is).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

KINDS = ("assign", "access", "hex", "random")
#: The base patterns; group 2, or the whole match, must reach the length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}+", 0, 32),
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
BATTERY, Q, TEXT_IC = 0.001, 0.01, 0.065
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: encoding: (pattern of the whole body, alphabet in order); the first that fits is inferred.
ENCODINGS = {
    "decimal": (r"^[0-9]+$", _DIGITS),
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    "base32": (r"^[A-Z2-7]+$", _UPPER + "234567"),
    "letters": (r"^([a-z]+|[A-Z]+)$", _LOWER),
    "base36": (r"^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER),
    "letters52": (r"^[A-Za-z]+$", _UPPER + _LOWER),
    "base62": (r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", _UPPER + _LOWER + _DIGITS + "+/-_"),
}
FOLDED = ("hex", "letters", "base36")  # one case at a time: read in lower case
BANDS = (28, 40, 64)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def find(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,end,ok,word>> of the matches of pattern, in order, whose group has least characters or more.

    The stretches between matches come from split, the matches from regexp_extract_all; running lengths give places. They
    run within blocks of about the square root of the number of matches, from the sums of the blocks before, as an array
    that grows by one in each step is copied each time."""
    zero = F.lit(0).cast("long")
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern), lambda x: F.length(x).cast("long")).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x).cast("long")).alias("g"),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,ok:boolean,word:string>>")
    long = lambda m: m["gap"] + F.coalesce(F.length(m["word"]), F.lit(0))

    def step(s: Column, m: Column) -> Column:
        start, end = s["at"] + m["gap"], s["at"] + long(m)
        add = F.when(m["word"].isNotNull(), F.array(F.struct(start.alias("start"), end.alias("end"), (m["g"] >= least).alias("ok"), m["word"].alias("word")))).otherwise(none)
        return F.struct(end.alias("at"), F.concat(s["found"], add).alias("found"))

    def blocks(p: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(p))).cast("int")
        block = lambda k: F.slice(p, k * size + 1, size)
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda k: F.aggregate(block(k), zero, lambda s, m: s + long(m)))
        first = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("starts"))
        starts = F.aggregate(sums, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        return F.flatten(F.transform(starts, lambda at, k: F.aggregate(block(k), F.struct(at.alias("at"), none.alias("found")), step, lambda s: s["found"])))

    return F.when(text.rlike(pattern), F.filter(_let(parts, blocks), lambda x: x["ok"])).otherwise(none)


def _ranks(values: Column, marks: Column, after: bool) -> Column:
    """For each of the sorted values, how many of marks are less (after: or equal): its place among all of them, less its own."""
    both = F.concat(F.transform(values, lambda x: F.struct(x.alias("x"), F.lit(int(after)).alias("tag"), F.lit(True).alias("own"))), F.transform(marks, lambda x: F.struct(x.alias("x"), F.lit(1 - int(after)).alias("tag"), F.lit(False).alias("own"))))
    placed = F.transform(F.sort_array(both), lambda s, i: F.struct(s["own"].alias("own"), i.alias("i")))
    return F.transform(F.filter(placed, lambda s: s["own"]), lambda s, j: s["i"] - j)


def _upper_tail(z: Column) -> Column:
    """P(normal > z), relative error under 0.3 % everywhere; also far out."""
    a = F.least(F.abs(z), F.lit(37.0))
    q = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) / (a * 0.661 + F.sqrt(a * a + 5.51) * 0.339)
    return F.when(z >= 0, q).otherwise(1 - q)


def _chi_z(x: Column, k: Column) -> Column:
    """Normal score of a chi-squared value by its cube root."""
    return (F.pow(x / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))


def battery(token: Column) -> Column:
    """struct<stratum, bin, random> of one candidate: see the module's docstring."""
    body = F.regexp_replace(token, "=+$", "")
    code = F.lit(None).cast("string")
    for name in reversed(ENCODINGS):
        code = F.when(body.rlike(ENCODINGS[name][0]), F.lit(name)).otherwise(code)

    def tests(c: Column) -> Column:
        alphabet = F.create_map(*[F.lit(v) for name, (_, a) in ENCODINGS.items() for v in (name, a)])[c["code"]]
        halves, levels = (F.create_map(*[F.lit(v) for name, (_, a) in ENCODINGS.items() for v in (name, "".join(f(i, len(a)) for i in range(len(a))))])[c["code"]] for f in (lambda i, n: "01"[2 * i >= n], lambda i, n: "0123456789abcdef"[16 * i // n]))
        text = F.when(c["code"].isin(*FOLDED), F.lower(c["body"])).otherwise(c["body"])
        bits = F.call_function("translate", text, alphabet, halves)
        steps = F.transform(F.split(F.call_function("translate", text, alphabet, levels), ""), lambda x: F.ascii(x) - F.when(x >= "a", 87).otherwise(48))
        size = F.length(alphabet).cast("double") - F.when(c["code"] == "base64", 2.0).otherwise(0.0)
        symbols = F.sort_array(F.split(text, ""))
        squares = F.aggregate(symbols, F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")), lambda s, x: _let(F.when(x == s["c"], s["run"] + 1).otherwise(F.lit(1.0)), lambda run: F.struct(x.alias("c"), run.alias("run"), (s["sum"] + 2 * run - 1).alias("sum"))), lambda s: s["sum"])
        pairs = lambda two: (F.length(bits) - F.length(F.replace(bits, F.lit(two)))) / 2
        series = F.aggregate(steps, F.struct(*[F.lit(0.0).alias(k) for k in ("s", "q", "x", "last")], F.lit(0).alias("n")), lambda s, v: F.struct((s["s"] + v).alias("s"), (s["q"] + v * v).alias("q"), (s["x"] + F.when(s["n"] > 0, s["last"] * v).otherwise(0.0)).alias("x"), v.cast("double").alias("last"), (s["n"] + 1).alias("n")))
        n = F.length(text).cast("double")
        raw = F.struct(n.alias("n"), size.alias("a"), squares.alias("sq"), (n - F.length(F.replace(bits, F.lit("1")))).alias("ones"), (pairs("01") + pairs("10") + 1).alias("runs"), series.alias("t"), c["code"].alias("code"))
        return _let(raw, judge)

    def judge(v: Column) -> Column:
        n, a = v["n"], v["a"]
        k = a - 1
        chi = v["sq"] * a / n - n
        p_chi = F.least(F.lit(1.0), 2 * F.least(_upper_tail(_chi_z(chi + 1e-9, k)), 1 - _upper_tail(_chi_z(chi + 1e-9, k))))
        mean = 2 * v["ones"] * (n - v["ones"]) / n + 1
        spread = F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
        p_runs = 2 * _upper_tail(F.abs(v["runs"] - mean) / F.sqrt(spread))
        m = v["t"]["s"] / n
        var = F.greatest(v["t"]["q"] - n * m * m, F.lit(1e-9))
        r = (v["t"]["x"] - (n - 1) * m * m) / var
        p_serial = 2 * _upper_tail(F.abs(r) * F.sqrt(n))
        # chi-squared of text: noncentral, read as a scaled central one with the same mean and variance
        lam = n * (a * F.greatest(F.lit(TEXT_IC), 2 / a) - 1)
        c, h = (k + 2 * lam) / (k + lam), (k + lam) * (k + lam) / (k + 2 * lam)
        p_text = _upper_tail(-_chi_z((chi + 1e-9) / c, h))
        band = sum(((n >= b).cast("int") for b in BANDS), F.lit(0))
        return F.struct(F.concat(v["code"], F.lit("-"), band.cast("string")).alias("stratum"), F.floor(-10 * F.log10(F.greatest(p_text, F.lit(1e-300)))).cast("int").alias("bin"), (F.least(p_chi, p_runs, p_serial) * 3 >= BATTERY).alias("random"))

    return _let(F.struct(F.when(F.length(body) == 0, F.lit("A")).otherwise(body).alias("body"), F.coalesce(code, F.lit("base64")).alias("code")), tests)


def _bh(candidates: DataFrame) -> dict[str, int]:
    """Least bin of each stratum that Benjamini-Hochberg accepts. At most len(ENCODINGS) * (len(BANDS) + 1) strata."""
    hist = candidates.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = hist.withColumn("above", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("stratum")))
    good = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("m") <= Q * F.col("above"))
    return {r["stratum"]: r["bin"] for r in good.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame) -> DataFrame:
    """See the module's docstring."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    df = df.select("doc_id", "text", *[find(F.col("text"), p, g, n).alias(k) for k, p, g, n in BASE], find(F.col("text"), CANDIDATE, 0, 20).alias("runs"))

    def kind(i: int):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"))

    df = df.withColumn("base", F.sort_array(F.concat(*[F.transform(F.col(k), kind(i)) for i, k in enumerate(KINDS[:3])])))
    # base spans that start before a run's end, less those that end by its start: the spans that it meets
    met = _let(
        F.struct(_ranks(F.col("runs.end"), F.col("base.start"), False).alias("a"), _ranks(F.col("runs.start"), F.col("base.end"), True).alias("b")),
        lambda c: F.filter("runs", lambda r, j: F.get(c["a"], j) == F.get(c["b"], j)),
    )
    free = F.when((F.size("runs") > 0) & (F.size("base") > 0), met).otherwise(F.col("runs"))
    tested = F.transform(free, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), battery(r["word"]).alias("test")))
    light = durable(df.select("doc_id", *KINDS[:3], "base", tested.alias("tested")), "secret-candidates")
    limit = _bh(light.select(F.explode("tested").alias("t")).select("t.test.stratum", "t.test.bin"))
    least = F.create_map(*[F.lit(v) for kv in limit.items() for v in kv]) if limit else F.create_map(F.lit(""), F.lit(0))
    kept = F.filter("tested", lambda x: x["test"]["random"] & (x["test"]["bin"] >= F.coalesce(F.try_element_at(least, x["test"]["stratum"]), F.lit(1 << 30))))
    extra = F.transform(kept, kind(3))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    n = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return light.select("doc_id", *[n(k) for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", extra))).alias("spans"), F.size(extra).cast("long").alias("n_random"))
