"""Stored tables with keys, changed by copy on write.

A table is a set of Parquet files that its newest manifest names, each with the least and greatest value of the first key
column. A change reads the files that hold a key of it, and no others, writes their rows anew with the change applied, and
commits a manifest that names the new files in their place. Readers see whole versions; a writer that loses the race for a
version throws its files away and applies its change to the winner's version. Rows are sorted by key within files and dealt
out by ranges of it, so a read of few keys opens few files (`lookup`), and row groups of those.

A change may carry the name of its writer and a growing number: the manifest keeps the last one of each writer, so a batch
that is sent again after a failure changes nothing. Keys may be null: null equals null. A change brings at most one row for
each key (merge and insert say what becomes of more). Nothing is collected but file names and their ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from .manifest import Manifests

#: Rows of a file, and bytes of them in memory, about: a task that writes one sorts these.
FILE_ROWS, FILE_BYTES = 1_000_000, 1 << 25

Rule = Callable[[DataFrame, DataFrame], DataFrame]
FIXED = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


def width(columns: StructType) -> Column:
    """Bytes of a row in memory, about: text compresses so well in files that their size says little."""
    out = F.lit(16 * len(columns) + 16).cast("long")
    for f in columns:
        if not isinstance(f.dataType, FIXED):
            out += F.coalesce(F.octet_length(F.col(f.name) if isinstance(f.dataType, (StringType, BinaryType)) else F.to_json(F.struct(f.name))), F.lit(0))
    return out


class StoredTable:
    def __init__(self, spark: SparkSession, root: str, columns: str | StructType, keys: tuple[str, ...], order: tuple = (), file_rows: int = FILE_ROWS):
        """columns: those of a table without a version yet, later ones have what they were made with. The first key is a
        string or whole number. order: what rows of an equal first key are sorted by within files."""
        self.spark, self.root, self.keys, self.order, self.file_rows = spark, root, tuple(keys), tuple(order), file_rows
        if isinstance(columns, StructType):  # as files have them: nulls allowed everywhere
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        self.columns = StructType.fromDDL(columns)
        self.manifests = Manifests(spark, root)

    # --- versions

    def version(self) -> int:
        return self.manifests.newest()

    def state(self, version: int | None = None) -> dict:
        """files: {name: {rows, bytes, low, high, nulls}}, columns, batches: {writer: last number}."""
        version = self.version() if version is None else version
        return self.manifests.load(version) if version else {"files": {}, "columns": self.columns.jsonValue(), "batches": {}}

    def holds(self, writer: str, batch: int) -> bool:
        """True if the writer's batch, or a later one, was committed."""
        return self.state()["batches"].get(writer, -1) >= batch

    def _frame(self, state: dict, names: list[str]) -> DataFrame:
        columns = StructType.fromJson(state["columns"])
        if not names:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*[f"{self.root}/{n}" for n in names])

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version; none before the first commit."""
        state = self.state(version)
        return self._frame(state, list(state["files"]))

    def lookup(self, *values, version: int | None = None) -> DataFrame:
        """The rows whose first key is one of values, from the files whose range holds one."""
        state = self.state(version)
        names = [n for n, f in state["files"].items() if any((v is None and f["nulls"]) or (v is not None and f["low"] is not None and f["low"] <= v <= f["high"]) for v in values)]
        some = [v for v in values if v is not None]
        wanted = F.col(self.keys[0]).isin(some)
        return self._frame(state, names).where(wanted | F.col(self.keys[0]).isNull() if len(some) < len(values) else wanted)

    # --- changes

    def merge(self, changes: DataFrame, rule: Rule, writer: str | None = None, batch: int | None = None) -> int:
        """Puts rule(rows with a key of changes, changes) in the place of those rows; the new version.

        An empty change and a batch that was committed before make no version."""

        def make(state: dict, staged: DataFrame) -> tuple[list[str], DataFrame]:
            keys = staged.select(*self.keys).distinct()
            touched = self._holding(state, keys)
            here = self._frame(state, touched)
            kept, old = self._join(here, keys, "left_anti"), self._join(here, keys, "left_semi")
            return touched, kept.unionByName(self._aligned(rule(old, staged), state))

        return self._change(changes, make, writer, batch)

    def upsert(self, changes: DataFrame, keep: tuple[str, ...] = (), writer: str | None = None, batch: int | None = None) -> int:
        """Rows of changes replace those of equal key, but for the columns in keep, which an older row keeps."""

        def rule(old: DataFrame, new: DataFrame) -> DataFrame:
            if not keep:
                return new
            was = old.select(*[F.col(k).alias(f"__{k}") for k in self.keys], *[F.col(c).alias(f"__old_{c}") for c in keep], F.lit(True).alias("__was"))
            joined = new.join(was, self._same({k: f"__{k}" for k in self.keys}), "left")
            return joined.select(*[F.when(F.col("__was"), F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns])

        return self.merge(changes, rule, writer, batch)

    def add(self, changes: DataFrame, counters: tuple[str, ...], writer: str | None = None, batch: int | None = None) -> int:
        """Adds the counters of changes, which may have several rows for a key, to those stored; a new key starts at 0."""
        sums = lambda df: df.groupBy(*self.keys).agg(*[F.sum(c).cast("long").alias(c) for c in counters])
        return self.merge(sums(changes), lambda old, new: sums(old.select(*new.columns).unionByName(new)), writer, batch)

    def delete(self, keys: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        return self.merge(keys.select(*self.keys).distinct(), lambda old, _: old.limit(0), writer, batch)

    def insert(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """Adds the rows whose key is not stored yet, one of each key; no stored file is read beyond its keys, or rewritten."""

        def make(state: dict, staged: DataFrame) -> tuple[list[str], DataFrame]:
            fresh = staged.dropDuplicates(list(self.keys))
            if state["files"]:
                fresh = self._join(fresh, self._frame(state, self._near(state, staged)).select(*self.keys), "left_anti")
            return [], self._aligned(fresh, state)

        return self._change(rows, make, writer, batch)

    def vacuum(self, versions: int = 1) -> list[str]:
        """Deletes all versions but the newest few, and the files that only those name; the names of these."""
        there = self.manifests.versions()
        named = [set(self.manifests.load(v)["files"]) for v in there]
        gone = sorted(set().union(*named[:-versions]) - set().union(*named[-versions:])) if named else []
        for name in gone:
            self.manifests.delete(name)
        for v in there[:-versions]:
            self.manifests.delete(f"manifests/manifest-{v:08d}")
        return gone

    # --- how

    def _same(self, names: dict[str, str]) -> Column:
        out = F.lit(True)
        for a, b in names.items():
            out = out & F.col(a).eqNullSafe(F.col(b))
        return out

    def _join(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        other = keys.toDF(*[f"__key_{k}" for k in range(len(self.keys))])
        return rows.join(other, self._same({k: f"__key_{i}" for i, k in enumerate(self.keys)}), how)

    def _near(self, state: dict, rows: DataFrame) -> list[str]:
        """Files whose range of the first key meets that of rows."""
        key = F.col(self.keys[0])
        low, high, nulls = rows.agg(F.min(key), F.max(key), F.coalesce(F.bool_or(key.isNull()), F.lit(False))).first()
        return [n for n, f in state["files"].items() if (nulls and f["nulls"]) or (None not in (low, f["low"]) and f["low"] <= high and low <= f["high"])]

    def _holding(self, state: dict, keys: DataFrame) -> list[str]:
        """Files that hold a key: of those in range, by a scan of their key columns."""
        near = self._near(state, keys)
        if not near:
            return []
        rows = self._frame(state, near)
        found = self._join(rows.select(*self.keys, rows.metadataColumn("_metadata")["file_path"].alias("__path")), keys, "left_semi")
        ends = {r[0].rsplit("/data/", 1)[1] for r in found.select("__path").distinct().collect()}
        return [n for n in near if n.split("data/", 1)[1] in ends]

    def _aligned(self, rows: DataFrame, state: dict) -> DataFrame:
        """rows in the columns of the table; columns that they lack are null."""
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromJson(state["columns"])])

    def _write(self, rows: DataFrame, most: int, size: int) -> dict:
        """Writes rows, most or fewer of about so many bytes, by ranges of the key; {file: rows, bytes, low, high, nulls}."""
        folder = f"data/{uuid.uuid4().hex}"
        files = max(1, round(most / self.file_rows), -(-size // FILE_BYTES))
        # one file too gets an exchange: without it all work ahead of the sort would run in its one task
        dealt = rows.repartitionByRange(files, *self.keys) if files > 1 else rows.repartition(1)
        dealt.sortWithinPartitions(self.keys[0], *self.order, *self.keys[1:]).write.parquet(f"{self.root}/{folder}")
        key = F.col(self.keys[0])
        there = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}")
        name = F.concat(F.lit(f"{folder}/"), there.metadataColumn("_metadata")["file_name"])
        stats = there.select(*self.keys, width(rows.schema).alias("__width"), name.alias("__name")).groupBy("__name").agg(F.count("*"), F.sum("__width"), F.min(key), F.max(key), F.bool_or(key.isNull()))
        return {r[0]: {"rows": r[1], "bytes": r[2], "low": r[3], "high": r[4], "nulls": r[5]} for r in stats.collect()}

    def _change(self, changes: DataFrame, make: Callable[[dict, DataFrame], tuple[list[str], DataFrame]], writer: str | None, batch: int | None) -> int:
        if (writer is None) != (batch is None):
            raise ValueError("a writer needs a batch number and the other way round")
        staging = f"staging/{uuid.uuid4().hex}"
        base = self.version()
        if writer is not None and self.state(base)["batches"].get(writer, -1) >= batch:
            return base
        changes.write.parquet(f"{self.root}/{staging}")  # read more than once below, and by every attempt
        try:
            staged = self.spark.read.schema(changes.schema).parquet(f"{self.root}/{staging}")
            n, size = staged.agg(F.count("*"), F.coalesce(F.sum(width(changes.schema)), F.lit(0))).first()
            if not n and writer is None:
                return base
            while True:
                base = self.version()
                state = self.state(base)
                if writer is not None and state["batches"].get(writer, -1) >= batch:
                    return base
                gone, rows = make(state, staged) if n else ([], staged)
                old = [state["files"][f] for f in gone]
                new = self._write(rows, n + sum(f["rows"] for f in old), size + sum(f.get("bytes", 0) for f in old)) if n else {}
                files = {n: f for n, f in state["files"].items() if n not in gone} | new
                content = {"version": base + 1, "columns": state["columns"], "files": files, "batches": state["batches"] | ({writer: batch} if writer is not None else {})}
                if self.manifests.commit(base + 1, content):
                    return base + 1
                for folder in {n.rsplit("/", 1)[0] for n in new}:
                    self.manifests.delete(folder)
        finally:
            self.manifests.delete(staging)
