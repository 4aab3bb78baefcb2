"""Text comparison: word and paragraph diffs with paired modifications, and word-bag similarity.

A diff follows a longest common subsequence; deletions come before insertions. Words are runs of letters, digits, _,
combining marks and joiners, so a Bengali syllable stays whole; white space stays as tokens of its own, any other
character is a token. Null texts count as empty.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS

_TOKEN = regex.compile(f"[{WS}]+|[\\p{{L}}\\p{{N}}\\p{{M}}_\u200c\u200d]+|.", regex.S)
_WORD = re.compile(f"[^{WS}]+")
_BREAK = re.compile(f"\\r?\\n[{WS}]*\\r?\\n")
#: Pairs of up to SHORT words on either side are modifications, longer ones from ALIKE on.
SHORT, ALIKE = 6, 0.3
#: Bits of the table that one trace may hold; larger ones are halved first.
CELLS = 1 << 28


def dice(a: list[str], b: list[str]) -> float:
    """Shared words of two bags, twice, over all words; 1 for two empty bags."""
    if not a or not b:
        return float(not a and not b)
    x, y = (Counter("\n".join(w).lower().split("\n")) for w in (a, b))
    return 2 * sum((x & y).values()) / (len(a) + len(b))


def _rows(a: list, b: list):
    """After each value of a: bits of b, 0 where the common subsequence with all of a so far grows by one there."""
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the common subsequence of a with each prefix of b."""
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _trace(a: list, b: list) -> list[tuple[int, int]]:
    size = len(b) // 8 + 1
    rows = [v.to_bytes(size, "little") for v in _rows(a, b)]
    grows = lambda i, j: not rows[i][j >> 3] >> (j & 7) & 1
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if not grows(i, j):
            j -= 1
        elif i and grows(i - 1, j):
            i -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence, in order. Memory is linear: large tables are halved by a's middle."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        x, y = a[i:n], b[j:m]
        if len(x) > 1 and len(x) * len(y) > CELLS:
            half = len(x) // 2
            both = _lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]
            cut = int(np.argmax(both))
            todo += [(i, i + half, j, j + cut), (i + half, n, j + cut, m)]
        elif x and y:
            out += [(i + p, j + q) for p, q in _trace(x, y)]
    return sorted(out)


def changes(a: list[str], b: list[str], glue: str) -> list[tuple[str, str, int]]:
    """(kind, text, tokens) of runs: within a changed stretch all that was removed comes first."""
    out: list[tuple[str, list[str]]] = []
    i = j = 0
    for x, y in [*common(a, b), (len(a), len(b))]:
        out += [(kind, part) for kind, part in (("removed", a[i:x]), ("added", b[j:y])) if part]
        if x < len(a):
            if out and out[-1][0] == "equal":
                out[-1][1].append(a[x])
            else:
                out.append(("equal", [a[x]]))
        i, j = x + 1, y + 1
    return [(k, glue.join(v), len(v)) for k, v in out]


def compare(source: str, target: str, mode: str = "word") -> dict:
    """Segments, modifications and statistics of one pair of texts."""
    if mode == "word":
        runs = changes(_TOKEN.findall(source or ""), _TOKEN.findall(target or ""), "")
    else:
        cut = lambda t: [p for p in (re.sub(f"^[{WS}]+|[{WS}]+$", "", p) for p in _BREAK.split(t or "")) if p]
        runs = changes(cut(source), cut(target), "\n\n")
    words = [_WORD.findall(v) for _, v, _ in runs]
    n = {"unchanged": 0, "removed": 0, "added": 0, "mod_removed": 0, "mod_added": 0}
    mods = removals = additions = 0
    i = 0
    while i < len(runs):
        kind = runs[i][0]
        if kind == "equal":
            n["unchanged"] += len(words[i])
        elif i + 1 < len(runs) and runs[i + 1][0] not in ("equal", kind) and (max(len(words[i]), len(words[i + 1])) <= SHORT or dice(words[i], words[i + 1]) >= ALIKE):
            for k in (i, i + 1):
                n[f"mod_{runs[k][0]}"] += len(words[k])
            mods += 1
            i += 1
        else:
            n[kind] += len(words[i])
            removals, additions = removals + (kind == "removed"), additions + (kind == "added")
        i += 1
    s, t = n["unchanged"] + n["removed"] + n["mod_removed"], n["unchanged"] + n["added"] + n["mod_added"]
    tokens = Counter()
    for kind, _, k in runs:
        tokens[kind] += k
    return {"segments": [{"kind": k, "value": v} for k, v, _ in runs], "equal_tokens": tokens["equal"], "removed_tokens": tokens["removed"], "added_tokens": tokens["added"], "modifications": mods, "removals": removals, "additions": additions, "unchanged_words": n["unchanged"], "source_words": s, "target_words": t, "changed_words": s + t - 2 * n["unchanged"], "similarity": min(1.0, 2 * n["unchanged"] / (s + t)) if s + t else 1.0}


RESULT = "segments array<struct<kind:string,value:string>>, equal_tokens long, removed_tokens long, added_tokens long, modifications long, removals long, additions long, unchanged_words long, source_words long, target_words long, changed_words long, similarity double"


#: Segments that are Python objects at once, about.
HELD = 1 << 14


def compare_batch(source: pa.Array, target: pa.Array, mode: str, segments: bool) -> pa.Array:
    """RESULT of many pairs; segments leave Python's memory as they are made."""
    done, kinds, values, ends, numbers = [], [], [], [0], []

    def flush() -> None:
        done.append(pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"]))
        kinds.clear()
        values.clear()

    for a, b in zip(source, target, strict=True):
        found = compare(a.as_py(), b.as_py(), mode)
        runs = found.pop("segments") if segments else found.pop("segments")[:0]
        kinds += [s["kind"] for s in runs]
        values += [s["value"] for s in runs]
        ends.append(ends[-1] + len(runs))
        numbers.append(tuple(found.values()))
        if len(kinds) > HELD:
            flush()
    flush()
    columns = list(zip(*numbers, strict=True)) or [()] * 11
    arrays = [pa.array(x, pa.int64()) for x in columns[:-1]] + [pa.array(columns[-1], pa.float64())]
    names = ["segments", "equal_tokens", "removed_tokens", "added_tokens", "modifications", "removals", "additions", "unchanged_words", "source_words", "target_words", "changed_words", "similarity"]
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(done)), *arrays], names=names)


def compare_columns(source: Column, target: Column, mode: str = "word", segments: bool = True) -> Column:
    """Struct column RESULT of the two texts of a row; without segments that list is empty."""

    @F.arrow_udf(RESULT)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return compare_batch(a, b, mode, segments)

    return run(source, target)


def bag_similarity(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) for distinct pairs (a, b) of ids in texts (id, text): word bags, counted once for each pair and word."""
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(True).alias("left")), F.struct(F.col("b").alias("id"), F.lit(False).alias("left")))).alias("s")).select("a", "b", "s.*")
    words = sides.join(texts.select("id", "text"), "id").select("a", "b", "left", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[^{WS}]+"), F.lit(0))).alias("w"))
    counts = words.groupBy("a", "b", "w").agg(F.count_if("left").alias("n"), F.count_if(~F.col("left")).alias("m"))
    total = counts.groupBy("a", "b").agg(F.sum(F.least("n", "m")).alias("both"), F.sum(F.col("n") + F.col("m")).alias("words"))
    return pairs.join(total, ["a", "b"], "left").select("a", "b", F.coalesce(2 * F.col("both") / F.col("words"), F.lit(1.0)).alias("similarity"))


def pair_similarity(source: Column, target: Column) -> Column:
    """Word-bag similarity of the two texts of a row, null texts as empty."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dice(_WORD.findall(x or ""), _WORD.findall(y or "")) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(source, target)


def gate(source: Column, target: Column, limit: Column) -> Column:
    """Why a pair is not compared: blank (either side), over_limit (either side), or null where it is."""
    used = [F.coalesce(F.length(F.regexp_replace(t, f"[{WS}]+", "")), F.lit(0)) for t in (source, target)]
    return F.when(F.least(*used) == 0, "blank").when(F.greatest(*used) > limit, "over_limit")


def badges(result: Column) -> Column:
    """struct<percent, added, removed> of a comparison: half of a percent counts up, halves of modifications count too."""
    return F.struct(F.floor(result["similarity"] * 100 + 0.5).cast("long").alias("percent"), (result["additions"] + result["modifications"]).alias("added"), (result["removals"] + result["modifications"]).alias("removed"))
