"""Operator 11, fill-in-middle: pieces of texts, secondary-sorted by their place in the output and again for restoration.

Contract of `fim_digests`: every row comes back with n (units), form, prefix_chars and middle_chars (code points; null if
plain), output_sha256 and restored_sha256. Units are a word with the ASCII white space ahead of it, and white space at the
end. Two cuts and the form come from the sha-256 of seed:doc_id. A null text is empty, an empty text or one that holds a
mark is plain. A null doc_id is written as no digits. Repeated rows are rows of their own, with equal results; extra columns
are ignored; an empty table gives no rows. `fim_texts` gives the outputs themselves, `restored_texts` undoes them.

A row becomes a head and pieces of whole units, CHUNK bytes or a little less each (a longer unit is cut), keyed by row and
place in the output. repartitionAndSortWithinPartitions deals them out by row and sorts them, so a task streams each
output piece by piece into its digest, however long the text. What it read is split at the marks again and keyed by place
in the text; a second repartitionAndSortWithinPartitions with the same partitioner moves nothing between machines, only
sorts, and the task streams the restored text into a digest. There are as many partitions as the bytes of all texts ask for
(SORTED each), and sorting spills beyond the Python worker's memory. A row is
named by its input partition and its number there, which lost executors do not change as long as docs are read from a
table; write other frames to one first. One row's pieces meet in one task because a digest is sequential; rows are dealt
out evenly whatever their ids or texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

#: Marks of the output format: fixed values.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
CHUNK = 1 << 16
#: Bytes of text in a sorted partition, about: what a task sorts in memory.
SORTED = 32 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


@dataclass(frozen=True)
class Rule:
    """seed; percent of texts that are transformed; percent of those with the suffix first; bytes of a piece."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    chunk: int = CHUNK


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets at which the units end."""
    _, ends, _ = tv.spans(raw, np.array([0, len(raw)]))
    return ends if len(raw) == (ends[-1] if len(ends) else 0) else np.append(ends, len(raw))


def choose(doc_id: int | None, text: bytes, n: int, rule: Rule) -> tuple[str, int, int]:
    """(form, units ahead of the first cut, units ahead of the second)."""
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rule.rate:
        return "plain", low, high
    return ("spm" if h[3] % 100 < rule.suffix_first else "psm"), low, high


def chunks(ends: np.ndarray, low: int, high: int, most: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of low to high, of whole units where they fit in most bytes; one empty range if there is nothing."""
    at = low
    while True:
        if high - at <= most:
            yield at, high
            return
        k = int(np.searchsorted(ends, at + most, side="right")) - 1
        cut = int(ends[k]) if k >= 0 and ends[k] > at else at + most
        yield at, cut
        at = cut


def packed(piece: bytes) -> bytes:
    """A piece as it is shuffled: compressed, behind a byte that says so, where that is shorter."""
    small = zlib.compress(piece, 1) if len(piece) > 128 else piece
    return b"z" + small if len(small) < len(piece) else b"=" + piece


def unpacked(piece: bytes) -> bytes:
    return zlib.decompress(memoryview(piece)[1:]) if piece[:1] == b"z" else piece[1:]


def row_pieces(doc_id: int | None, text: str | None, rule: Rule) -> Iterator[tuple[int, object]]:
    """(place in the output, piece) in the order of the text, after (-1, head)."""
    data = (text or "").encode()
    raw = np.frombuffer(data, np.uint8)
    ends = unit_ends(raw)
    n = len(ends)
    form, low, high = choose(doc_id, data, n, rule)
    if form == "plain":
        yield -1, (doc_id, n, form, None, None)
        for k, (a, b) in enumerate(chunks(ends, 0, len(data), rule.chunk)):
            yield k, packed(data[a:b])
        return
    first, second = (int(ends[k - 1]) if k else 0 for k in (low, high))
    chars = [int(((raw[a:b] & 0xC0) != 0x80).sum()) for a, b in ((0, first), (first, second))]
    yield -1, (doc_id, n, form, *chars)
    parts = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(data))}
    ranges = {m: list(chunks(ends, a, b, rule.chunk)) for m, (a, b) in parts.items()}
    place, at = {}, 0
    for m in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        place[m], at = at, at + len(ranges[m])
    for m, found in ranges.items():
        for k, (a, b) in enumerate(found):
            yield place[m] + k, packed((b"" if k else m) + data[a:b])


def by_row(key: tuple) -> int:
    """Partition of a key: rows of one input partition go round all partitions, from a start of its own."""
    (part, number), *_ = key
    return part * 1_000_003 + number


def output_pieces(docs: DataFrame, rule: Rule) -> tuple[RDD, int]:
    """RDD of ((row, place), head or piece), each row whole and in the order of its output in one partition; partitions."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    size = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SORTED))
    rows = docs.select(F.col("doc_id").cast("long"), "text").rdd

    def emit(part: int, found) -> Iterator:
        for number, (doc_id, text) in enumerate(found):
            for place, piece in row_pieces(doc_id, text, rule):
                yield ((part, number), place), piece

    return rows.mapPartitionsWithIndex(emit).repartitionAndSortWithinPartitions(size, by_row), size


def _rows(sorted_pieces: Iterator) -> Iterator[tuple[tuple, tuple, Iterator[bytes]]]:
    """(row, head, its pieces) of pieces in order. The pieces are to be used up before the next row is asked for."""
    pending = next(sorted_pieces, None)

    def pieces(row):
        nonlocal pending
        while (pending := next(sorted_pieces, None)) is not None and pending[0][0] == row:
            yield unpacked(pending[1])

    while pending is not None:
        (row, _), head = pending
        yield row, head, pieces(row)


def split_output(pieces: Iterator[bytes], form: str) -> Iterator[tuple[int, bytes]]:
    """(0 prefix, 1 middle, 2 suffix; piece) of an output read in order. A mark lies whole within a piece."""
    if form == "plain":
        for piece in pieces:
            yield 0, piece
        return
    order, section = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}, 0
    for piece in pieces:
        for part in re.split(rb"(<[PSM]>)", piece):
            if part in order:
                section = order[part]
            elif part:
                yield section, part


def fim_digests(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """See the module's docstring."""
    pieces, size = output_pieces(docs, rule)

    def assemble(found) -> Iterator:
        for row, head, parts in _rows(iter(found)):
            digest = hashlib.sha256()

            def read(parts=parts, digest=digest):
                for piece in parts:
                    digest.update(piece)
                    yield piece

            for k, (section, part) in enumerate(split_output(read(), head[2])):
                yield (row, section, k), part
            yield (row, 3, 0), (*head, digest.hexdigest())

    def restore(found) -> Iterator[tuple]:
        digest = hashlib.sha256()
        for (_, section, _), part in found:
            if section < 3:
                digest.update(part)
            else:
                yield (*part, digest.hexdigest())
                digest = hashlib.sha256()

    streamed = pieces.mapPartitions(assemble, preservesPartitioning=True)
    rows = streamed.repartitionAndSortWithinPartitions(size, by_row).mapPartitions(restore)
    return docs.sparkSession.createDataFrame(rows, f"{SCHEMA}, output_sha256 string, restored_sha256 string", verifySchema=False)


def fim_texts(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, text): the outputs. Each is one string in the end, as its input was."""
    pieces, _ = output_pieces(docs, rule)

    def join(found) -> Iterator[tuple]:
        for _, head, parts in _rows(iter(found)):
            yield (*head, b"".join(parts).decode())

    return docs.sparkSession.createDataFrame(pieces.mapPartitions(join), f"{SCHEMA}, text string", verifySchema=False)


def restored_texts(outputs: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """outputs with their texts put back in order, from the output and the form alone."""
    part: Callable = lambda mark, until: F.regexp_extract(text, f"(?s){mark}(.*?)(?:{until}|\\z)", 1)
    back = F.concat(part("<P>", "<[SM]>"), part("<M>", "<[PS]>"), part("<S>", "<[PM]>"))
    return outputs.withColumn(text, F.when(F.col(form) == "plain", F.col(text)).otherwise(back))


ORACLE_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM hashed
), cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM parts
"""
