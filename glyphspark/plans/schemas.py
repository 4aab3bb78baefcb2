"""Row schemas of the collections: issues of rows that break one, sinks that take valid rows only, bodies as JSON.

Columns are typed by Spark, so a field can be missing (null), too small, too large or no option. A row's issues read
"field: what is wrong", in the order of the fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """least and most bound numbers, least also the length of strings; above excludes its value."""

    name: str
    kind: str = "string"
    least: int | None = None
    above: int | None = None
    most: int | None = None
    options: tuple[str, ...] = ()
    nullable: bool = False

    def issue(self) -> Column:
        """What is wrong with the field of a row, or null."""
        c = F.col(self.name)
        said = F.lit(None).cast("string")
        if self.options:
            choice = "Invalid option: expected one of " + "|".join(f'"{o}"' for o in self.options)
            return self._named(F.when(c.isNull(), F.lit(None if self.nullable else choice)).when(~c.isin(*self.options), F.lit(choice)))
        if self.most is not None:
            said = F.when(c > self.most, f"Too big: expected number to be <={self.most}").otherwise(said)
        if self.above is not None:
            said = F.when(c <= self.above, f"Too small: expected number to be >{self.above}").otherwise(said)
        if self.least is not None and self.kind == "string":
            said = F.when(F.length(c) < self.least, f"Too small: expected string to have >={self.least} characters").otherwise(said)
        elif self.least is not None:
            said = F.when(c < self.least, f"Too small: expected number to be >={self.least}").otherwise(said)
        if not self.nullable:
            said = F.when(c.isNull(), f"Invalid input: expected {self.kind}, received null").otherwise(said)
        return self._named(said)

    def _named(self, said: Column) -> Column:
        return F.concat(F.lit(f"{self.name}: "), said)


def _count(*names: str) -> tuple[Field, ...]:
    return tuple(Field(n, "number", least=0) for n in names)


def _maybe(*names: str) -> tuple[Field, ...]:
    return tuple(Field(n, nullable=True) for n in names)


_TIER = Field("tier", options=("easy", "medium", "expert"))
_USER, _AT, _UPDATED = Field("userId", least=1), Field("createdAt"), Field("updatedAt")
FORMATS = ("pdf", "doc", "docx", "txt")
KINDS = ("unmapped_character", "conversion_failed", "file_extraction_failed", "validation_warning", "limit_exceeded", "rate_limited", "unknown")
#: The collections, their fields in order, and what each field must be.
COLLECTIONS: dict[str, tuple[Field, ...]] = {
    "users": (Field("uid", least=1), *_maybe("email", "displayName"), _TIER, _AT),
    "conversions": (_USER, _TIER, Field("encodingId", least=1), Field("inputType", options=("text", "file")), *_count("charCount", "wordCount"), Field("fileFormat", options=FORMATS, nullable=True), *_count("durationMs"), Field("status", options=("success", "error")), *_maybe("error"), _AT),
    "comparisons": (_USER, Field("mode", options=("word", "paragraph")), Field("similarity", "number", least=0, most=1), *_count("sourceWordCount", "targetWordCount", "changedWordCount"), _AT),
    "documents": (_USER, Field("storagePath", least=1), Field("fileName", least=1), Field("fileType", options=FORMATS), *_count("sizeBytes"), Field("extractionStatus", options=("success", "error")), _AT),
    "usage": (_USER, *_count("totalConversions", "totalComparisons", "totalDocuments", "totalCharsProcessed"), _UPDATED),
    "usageOverrides": (Field("uid", least=1), Field("maxNonWhitespaceChars", "number", above=0), _UPDATED, Field("updatedBy", least=1)),
    "systemConfig": (*(Field(f"{t}MaxNonWhitespaceChars", "number", above=0, nullable=True) for t in ("easy", "medium", "expert")), Field("enabledEncodings", "array", nullable=True), Field("maxUploadSizeBytes", "number", above=0, nullable=True), Field("documentsEnabled", "boolean", nullable=True), Field("comparisonEnabled", "boolean", nullable=True), _UPDATED),
    "auditLogs": (Field("actorUid", least=1), Field("action", least=1), Field("target", least=1), Field("metadata", "record"), _AT),
    "errorLogs": (*_maybe("userId"), Field("source", options=("text", "file", "comparison", "api")), Field("kind", options=KINDS), Field("severity", options=("error", "warning")), Field("code", least=1), Field("message", least=1), *_maybe("encodingId", "fileName", "fileType"), Field("samples", "array"), Field("occurrences", "number", above=0), *_maybe("route"), _AT),
    "feedback": (*_maybe("userId", "email"), Field("category", options=("wrong_conversion", "missing_character", "file_problem", "bug", "feature_request", "praise", "other")), Field("rating", "number", least=1, most=5, nullable=True), Field("message", least=1), *_maybe("page", "encodingId", "sampleInput", "sampleOutput"), Field("status", options=("new", "reviewed", "resolved")), *_maybe("adminNote"), _AT, _UPDATED),
    "adminStatsDaily": (Field("date"), *_count("conversions", "comparisons", "documents", "charsProcessed", "conversionErrors", "documentErrors")),
}


def issues(fields: tuple[Field, ...] | str) -> Column:
    """array<string> of what is wrong with a row; empty for a valid one."""
    return F.array_compact(F.array(*[f.issue() for f in (COLLECTIONS[fields] if isinstance(fields, str) else fields)]))


def valid(rows: DataFrame, collection: str) -> DataFrame:
    """The valid rows. After a limit it may leave fewer than the limit, as listings do."""
    return rows.where(F.size(issues(collection)) == 0)


def append_valid(rows: DataFrame, collection: str, path: str) -> DataFrame:
    """Appends the valid rows to a Parquet table, each under a new id; returns the others with their issues."""
    valid(rows, collection).select(F.expr("uuid()").alias("id"), "*").write.mode("append").parquet(path)
    return rows.withColumn("issues", issues(collection)).where(F.size("issues") > 0)


def delete_by_key(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of table whose key is not among keys: what stays after a delete."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def storage_path(uid: Column, doc_id: Column, name: Column) -> Column:
    """Where a user's original file is kept."""
    return F.concat_ws("/", F.lit("users"), uid, F.lit("documents"), doc_id.cast("string"), name)


def parse_bodies(rows: DataFrame, column: str, ddl: str, fields: tuple[Field, ...]) -> DataFrame:
    """rows, the fields of their JSON body (of type ddl, null where the body is malformed or has none), and issues."""
    parsed = rows.withColumn("__body", F.from_json(column, ddl))
    return parsed.select(*rows.columns, "__body.*").withColumn("issues", issues(fields))
