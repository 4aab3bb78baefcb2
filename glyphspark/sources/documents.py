"""Documents from files: binaryFile rows through typed extraction. Every row gets a text or an error, in a fixed order of checks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

MAX_BYTES = 15 * 1024 * 1024
#: Bytes that the text part of an archive may unpack to.
MAX_UNPACKED = 256 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit(None).cast("string").alias("mime"))


#: Elements of a text part that are read or, as marks and settings, say nothing that a text could hold.
_KNOWN = frozenset(
    "document body p r t tab br cr noBreakHyphen softHyphen tbl tr tc tblGrid gridCol sectPr sdt sdtContent hyperlink ins smartTag del delText moveTo moveFrom bookmarkStart bookmarkEnd proofErr lastRenderedPageBreak "
    "commentRangeStart commentRangeEnd commentReference footnoteReference endnoteReference annotationRef footnoteRef endnoteRef instrText fldChar fldSimple permStart permEnd background".split()
)


def docx_parts(data: bytes) -> tuple[str, list[str]]:
    """(text, notes) of an archive: paragraphs with an empty line after each, and a note for each kind of element that is
    left out, in the order in which they first stand."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo("word/document.xml").file_size > MAX_UNPACKED:
            raise OverflowError
        with z.open("word/document.xml") as f:
            data = f.read(MAX_UNPACKED + 1)
        if len(data) > MAX_UNPACKED:  # the archive's own figure need not be true
            raise OverflowError
        root = ElementTree.fromstring(data)
    out, left = [], {}
    for p in root.iter(f"{_W}p"):
        out.append("".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in p.iter()))
    todo = [root]
    while todo:  # what lies inside of an element that is left out, or of settings, is not told apart
        x = todo.pop()
        own = x.tag.startswith(_W)
        name = x.tag.removeprefix(_W) if own else x.tag.rpartition("}")[2]
        if own and name.endswith("Pr"):
            continue
        if own and name in _KNOWN:
            todo += reversed(list(x))
        else:
            left.setdefault(f"w:{name}" if own else name)
    # Fixed value: the words of a note.
    return "".join(f"{p}\n\n" for p in out), [f"An unrecognised element was ignored: {name}" for name in left]


def docx_text(data: bytes) -> str:
    return docx_parts(data)[0]


def _extract(kind: str | None, data: bytes | None) -> tuple[str | None, str | None, list[str] | None]:
    """(text, error, notes)"""
    notes: list[str] = []
    try:
        if kind == "txt":
            text = bytes(data).decode("utf-8", "replace").removeprefix("\ufeff")
        elif kind == "docx":
            text, notes = docx_parts(bytes(data))
        else:
            return None, "extraction_failed", None  # no reader for pdf and doc is installed
    except OverflowError:
        return None, "too_large", None
    except Exception:  # whatever a damaged file makes its reader say: a row, never a failed job
        return None, "corrupted", None
    return (text, None, notes or None) if re.sub(f"[{tx.WS}]+", "", text) else (None, "empty", None)


def extract(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, file_name, file_type, text, error, notes) of files (path, length, content, file_name, mime). The first check
    that fails names the error: empty, too_large, unsupported, then those of extraction. notes: what a text was read without,
    null if nothing."""

    @F.pandas_udf("text string, error string, notes array<string>")
    def run(kind: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_extract(k, d) if k else (None, None, None) for k, d in zip(kind, data, strict=True)], columns=["text", "error", "notes"])

    kind = tx.file_format(F.col("file_name"), F.col("mime"))
    gate = F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too_large").when(kind.isNull(), "unsupported")
    gated = files.withColumn("file_type", kind).withColumn("gate", gate)
    # content reaches Python only for rows that passed
    done = gated.withColumn("x", run(F.when(F.col("gate").isNull(), F.col("file_type")), F.when(F.col("gate").isNull(), F.col("content"))))
    return done.select("path", "file_name", "file_type", "x.text", F.coalesce("gate", "x.error").alias("error"), "x.notes")


def write_text(df: DataFrame, path: str) -> None:
    df.select(F.coalesce("text", F.lit("")).alias("value")).write.mode("append").text(path)
