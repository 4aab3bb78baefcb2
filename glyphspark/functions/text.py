"""Measures of text as built-in expressions. White space is ECMAScript's, which is neither Java's nor Python's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ECMAScript white space, for Java and Python patterns.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def non_ws_chars(text: Column) -> Column:
    """Code points that are not white space; null counts as none."""
    return F.coalesce(F.length(F.regexp_replace(text, f"[{WS}]+", "")), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, f"\\r?\\n[{WS}]*\\r?\\n"), trim), lambda x: x != "")


def unreliable_ratio(text: Column) -> Column:
    """Share of replacement and control characters other than tab, line feed and carriage return."""
    bad = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F�]"))
    return F.when(F.length(text) > 0, bad / F.length(text)).otherwise(0.0)


def file_format(name: Column, mime: Column) -> Column:
    """Format by the last suffix, else by exact MIME type, else null. A name without a dot is its own suffix."""
    # Suffixes and MIME types.
    by_mime = {"text/plain": "txt", "application/pdf": "pdf", "application/msword": "doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx"}
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    found = F.lit(None).cast("string")
    for m, f in by_mime.items():
        found = F.when(mime == m, F.lit(f)).otherwise(found)
    return F.when(suffix.isin(*by_mime.values()), suffix).otherwise(found)
