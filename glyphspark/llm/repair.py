"""Operator 13, repair of conversation structure: cheapest edits by dynamic programming over secondary-sorted turns.

Contract of `repair_digests` for rows (conv_id, turn, role, text): one row for each conv_id with gaps, blank, duplicate,
truncated, illegal, cost, audit and repaired_sha256. Nulls of role and text are one space. Rows stand in the order of turn
(null first), then role, then the first HEAD characters and the digest of role and text: equal rows are neighbours. A null
conv_id is a conversation. The first fault of a row counts: blank (only ASCII white space), duplicate (role and text seen
earlier in the conversation), truncated (the last other character is none of .!?). Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (forced for blank and
duplicate rows), Insert of an empty user or assistant turn 2; a truncated row that stays costs 1 more. The repaired roles
read, by their first letters, (s?(ua)+)?; of the cheapest audits (K, R, D, I in order) the ASCII-least is taken.
Conversations that only ids names give zeros, an empty audit and the hash of nothing; an empty table gives no rows.
Repeated rows are duplicates of each other; extra columns are ignored. `repaired_turns` gives the repaired turns
themselves, with the edit that made each.

The roles that may follow are known from the last one (nothing, s, u, a), so the last role is the state, and an edit leads
from one state to one other. Turns are dealt out by conversation and sorted by turn from the last to the first; mapInArrow
carries the cost of each state to the end of the conversation across Arrow batches and notes one byte a turn: for each
state, the least letter that starts a cheapest way on. After a conversation's first turn the notes are read back from the
start, and the way through them is the least audit. Only the differences of the costs are carried, so few states of the
whole exist, and a step is a look-up. The notes, and the texts that the repair keeps to hash, are spilled to a file without
a name in Spark's local folder beyond SPILL bytes and read from its end: no conversation is held in memory. A lost executor
loses no more than a task, which runs again. Earlier equal turns are found by grouping digests, without texts, over all
machines; only marks of turns that repeat one go to the conversation's task, whose work is sequential by nature.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the role that an inserted or renamed turn must have: a user everywhere but after a user.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: State after a kept turn by its first letter; none where it may not stand.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LETTERS, LEGAL = "DIKR", {"su", "ua", "au"}
DELETE, INSERT, RENAME, CUT = 3, 2, 2, 1
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SPILL = 8 << 20
#: Characters of a text that order equal turns of equal role, ahead of its digest.
HEAD = 64
SPACES = r"[\x20\x09-\x0D]"
DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, turn long, edit string, role string, text string"
#: Costs to the end after the last turn: a conversation ends at its start or after an assistant.
END = (0, 2 * INSERT, INSERT, 0)

_steps: dict[tuple, tuple] = {}


def step(costs: tuple, initial: str, fault: int) -> tuple[tuple, int, int]:
    """(costs, base, note) one turn earlier: costs by state less base; note: two bits for each state, the letter to take."""
    key = (costs, initial, fault)
    if key in _steps:
        return _steps[key]
    extra = CUT if fault == TRUNCATED else 0
    ways = []
    for state in range(4):
        way = {"D": DELETE + costs[state]}
        if fault not in (BLANK, DUPLICATE):
            if (state, initial) in KEEP:
                way["K"] = extra + costs[KEEP[state, initial]]
            way["R"] = RENAME + extra + costs[NEXT[state]]
        ways.append(way)
    best = [min(w.values()) for w in ways]
    for _ in range(4):  # insertions lead from state to state within a place
        best = [min(best[s], INSERT + best[NEXT[s]]) for s in range(4)]
    note = 0
    for s, way in enumerate(ways):
        way["I"] = INSERT + best[NEXT[s]]
        note |= LETTERS.index(min(k for k, v in way.items() if v == best[s])) << (2 * s)
    low = min(best)
    _steps[key] = tuple(b - low for b in best), low, note
    return _steps[key]


class Stack:
    """Rows pushed in order and read back from the last one; full blocks go to a file without a name."""

    def __init__(self, most: int = SPILL):
        self.most, self.rows, self.size, self.blocks, self.file = most, [], 0, [], None

    def push(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size
        if self.size > self.most:
            if self.file is None:
                folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
                self.file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            self.blocks.append(self.file.tell())
            pickle.dump(self.rows, self.file, protocol=5)
            self.rows, self.size = [], 0

    def backwards(self) -> Iterator[tuple]:
        yield from reversed(self.rows)
        self.rows = []
        for at in reversed(self.blocks):
            self.file.seek(at)
            yield from reversed(pickle.load(self.file))
        if self.file is not None:
            self.file.close()


class Conversation:
    """The turns of one conversation from the last to the first."""

    def __init__(self, conv_id: int | None):
        self.id, self.costs, self.cost, self.held = conv_id, END, 0, Stack()
        self.faults = [0] * 4
        self.illegal = self.distinct = 0
        self.first = self.last = self.after = None

    def turn(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.costs, base, note = step(self.costs, initial if initial in "sua" else "", fault)
        self.cost += base
        self.faults[fault] += 1
        if self.after is not None and initial + self.after not in LEGAL:
            self.illegal += 1
        self.after = initial
        if turn is not None and turn != self.first:
            self.distinct += 1
            self.first, self.last = turn, turn if self.last is None else self.last
        if fault in (BLANK, DUPLICATE):
            role = text = None
        self.held.push((note, turn, role, text), 80 + len(role or "") + len(text or ""))

    def edits(self) -> Iterator[tuple[str, int | None, str | None, str | None]]:
        """(letter, turn, role, text) of the edits in order; role and text are those of the repaired turn, null if deleted."""
        state = START
        for note, turn, role, text in self.held.backwards():
            while (letter := LETTERS[note >> (2 * state) & 3]) == "I":
                state = NEXT[state]
                yield "I", None, ROLES[state], ""
            if letter == "D":
                yield "D", turn, None, None
                continue
            state = KEEP[state, role[:1]] if letter == "K" else NEXT[state]
            yield letter, turn, role if letter == "K" else ROLES[state], text
        while END[state]:
            state = NEXT[state]
            yield "I", None, ROLES[state], ""

    def digest(self) -> tuple:
        audit, repaired = [], hashlib.sha256()
        begun = False
        for letter, _, role, text in self.edits():
            audit.append(letter)
            if letter != "D":
                repaired.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return self.id, gaps, *self.faults[1:], self.illegal, self.cost + self.costs[START], "".join(audit), repaired.hexdigest()


def conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[Conversation]:
    """Whole conversations of rows (conv_id, turn, role, text, fault, key, marked) in order. A mark comes ahead of the turns
    it stands for; of equal neighbours only the first of the conversation, that is the last read, is none."""
    now, pending, mark = None, None, None

    def settle(following):
        if pending is not None:
            turn, role, text, fault, key, marked = pending
            now.turn(turn, role, text, DUPLICATE if fault != BLANK and (marked or (turn, key) == following) else fault)

    for batch in batches:
        for conv_id, turn, role, text, fault, key, marked in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if now is None or conv_id != now.id:
                settle(None)
                if now is not None:
                    yield now
                now, pending, mark = Conversation(conv_id), None, None
            if marked:
                mark = (turn, key)
                continue
            settle((turn, key))
            pending = (turn, role, text, fault, key, mark == (turn, key))
    settle(None)
    if now is not None:
        yield now


def _faults(text: Column) -> Column:
    """Blank or truncated, by the text alone."""
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(text.rlike(rf"[.!?]{SPACES}*\z"), FINE).otherwise(TRUNCATED)


def ordered(turns: DataFrame) -> DataFrame:
    """Rows for conversations(): dealt out by conversation, from the last turn to the first, with marks of turns whose role
    and text an earlier turn has."""
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    digest = F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))
    rows = rows.select("*", _faults(F.col("text")).alias("fault"), digest.alias("key"), F.substring("text", 1, HEAD).alias("head"), F.lit(False).alias("marked"))
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    light = rows.select("conv_id", "turn", "role", "key", "head", at.alias("at"))
    first = light.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low < high")
    again = light.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")) & (F.col("at") > F.col("low")))
    marks = again.select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"), F.lit(FINE).alias("fault"), "key", "head", F.lit(True).alias("marked")).distinct()
    order = [F.col("turn").desc_nulls_last(), *(F.col(c).desc() for c in ("role", "head", "key", "marked"))]
    return gathered(rows.unionByName(marks), ["conv_id"], order).select("conv_id", "turn", "role", "text", "fault", "key", "marked")


def _batches(rows: Iterator[tuple], schema: str, most: int = SPILL) -> Iterator[pa.RecordBatch]:
    """Record batches of about most bytes of rows."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], pa.int64() if kind == "long" else pa.string()) for k, kind in enumerate(kinds)], names=list(names))

    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def repair_digests(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """See the module's docstring. ids: rows whose conv_id is to be returned even if turns has none of it."""

    def work(batches):
        return _batches((c.digest() for c in conversations(batches)), DIGESTS)

    out = ordered(turns).mapInArrow(work, DIGESTS)
    if ids is None:
        return out
    there = turns.select(F.col("conv_id").cast("long").alias("there")).distinct()
    rest = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(there, F.col("conv_id").eqNullSafe(F.col("there")), "left_anti")
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.unionByName(rest.select("conv_id", *zero, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256")))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position, turn, edit, role, text): the turns of each repaired conversation by position, from 0. Deleted
    turns are left out; inserted ones have no turn."""

    def rows(batches):
        for c in conversations(batches):
            kept = (e for e in c.edits() if e[0] != "D")
            for position, (letter, turn, role, text) in enumerate(kept):
                yield c.id, position, turn, {"K": "keep", "R": "rerole", "I": "insert"}[letter], role, text

    return ordered(turns).mapInArrow(lambda batches: _batches(rows(batches), TURNS), TURNS)


def damage(turns: DataFrame) -> DataFrame:
    """turns, damaged by a hash of conversation and turn as the contract of the query says; nulls of role and text are a
    space, and so are null numbers in what is hashed."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.crc32(name) % 20, F.coalesce("text", space)
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), text.alias("text"), times.alias("times")).where("times > 0")
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE k = 8
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS bytes FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) t(i)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM damaged
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
    left(role, 1) AS f, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS g FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
    count_if(fault = 3) AS truncated, count_if(g IS NOT NULL AND f || g NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), ways AS (
  SELECT conv_id, m + 1 AS n, {'c': 0, 'a': '', 'r': ''} AS z, {'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s,
    {'c': 2, 'a': 'I', 'r': chr(10) || 'assistant:'} AS u, {'c': 0, 'a': '', 'r': ''} AS a
  FROM placed WHERE n = 1
  UNION ALL
  SELECT conv_id, n, least(z, {'c': u.c + 2, 'a': 'I' || u.a, 'r': chr(10) || 'user:' || u.r}), least(s, {'c': u.c + 2, 'a': 'I' || u.a, 'r': chr(10) || 'user:' || u.r}), u, a
  FROM (
    SELECT conv_id, n, z, s, least(u, {'c': a.c + 2, 'a': 'I' || a.a, 'r': chr(10) || 'assistant:' || a.r}) AS u,
      least(a, {'c': u.c + 2, 'a': 'I' || u.a, 'r': chr(10) || 'user:' || u.r}) AS a
    FROM (
      SELECT w.conv_id, t.n,
        list_sort([{'c': z.c + 3, 'a': 'D' || z.a, 'r': z.r}, CASE f WHEN 's' THEN {'c': keep + s.c, 'a': 'K' || s.a, 'r': own || s.r} WHEN 'u' THEN {'c': keep + u.c, 'a': 'K' || u.a, 'r': own || u.r} ELSE {'c': 99999, 'a': '', 'r': ''} END, {'c': 2 + keep + u.c, 'a': 'R' || u.a, 'r': chr(10) || 'user:' || text || u.r}])[1] AS z,
        list_sort([{'c': s.c + 3, 'a': 'D' || s.a, 'r': s.r}, CASE f WHEN 'u' THEN {'c': keep + u.c, 'a': 'K' || u.a, 'r': own || u.r} ELSE {'c': 99999, 'a': '', 'r': ''} END, {'c': 2 + keep + u.c, 'a': 'R' || u.a, 'r': chr(10) || 'user:' || text || u.r}])[1] AS s,
        list_sort([{'c': u.c + 3, 'a': 'D' || u.a, 'r': u.r}, CASE f WHEN 'a' THEN {'c': keep + a.c, 'a': 'K' || a.a, 'r': own || a.r} ELSE {'c': 99999, 'a': '', 'r': ''} END, {'c': 2 + keep + a.c, 'a': 'R' || a.a, 'r': chr(10) || 'assistant:' || text || a.r}])[1] AS u,
        list_sort([{'c': a.c + 3, 'a': 'D' || a.a, 'r': a.r}, CASE f WHEN 'u' THEN {'c': keep + u.c, 'a': 'K' || u.a, 'r': own || u.r} ELSE {'c': 99999, 'a': '', 'r': ''} END, {'c': 2 + keep + u.c, 'a': 'R' || u.a, 'r': chr(10) || 'user:' || text || u.r}])[1] AS a
      FROM ways w JOIN (SELECT *, CASE fault WHEN 3 THEN 1 WHEN 0 THEN 0 ELSE 9999 END AS keep, chr(10) || role || ':' || text AS own FROM faulty) t
        ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = w.n - 1
    )
  )
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.z.c, 0)::BIGINT AS cost, coalesce(w.z.a, '') AS audit, sha256(coalesce(substr(w.z.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ways w ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND w.n = 1
"""
