"""Operator 4, sharding by size-tiered compaction: small immutable shards, merged runs, atomically committed manifests.

Contract of `ShardTable`: append(df) writes the rows of df as one run of small shards (one for each task of df) and
commits; compact() merges, as long as a size tier holds FANOUT runs or more, the runs of the lowest such tier into one
run of files of about target bytes and commits; read() gives the rows of the newest manifest, then the place of the run
in the manifest and of the file in the run, called __run and __shard or, where the rows have such columns, the same with
more underscores. Every appended row is in exactly one shard of a version, values unchanged; rows are never looked at, so
nulls, repeated rows, clashing names and empty texts pass through. An append without rows commits nothing. A store
without any commit reads as no rows of the two place columns.

The manifest keeps the columns of the store, and every run is read and merged by them. An append may lack columns (its rows
have null there) and may bring new ones (earlier rows have null there, nothing is rewritten). Names that differ only in case
are one column. A column must have its type in the store, or one that Spark widens to it without loss (int to long, float
to double); any other type is refused with SchemaClash before anything is committed, and the store stays
as it was.

A run is a folder that Spark wrote; it is never changed. A manifest lists the columns and the runs of one version (name,
bytes, files, tier). Its file is written beside and renamed to manifest-<version> without overwriting: one of two writers gets the
version, the other drops what it merged and starts again from the new one. Runs that no manifest names, from failed jobs,
are never read. Merged runs stay for readers of older versions until vacuum() removes what only those name.

The tier of a run is the power of FANOUT that its bytes are of the small size, so each row is rewritten once for each
tier at most. Merging moves no rows between machines: a task reads whole shards one after the other and writes one file.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from .common import free, shared_dir

TARGET, SMALL, FANOUT = 32 << 20, 1 << 20, 4
#: Types that an append may have where the store has the wider one, in order.
WIDER = (("tinyint", "smallint", "int", "bigint"), ("float", "double"))


class SchemaClash(ValueError):
    """An append whose columns cannot be stored beside those of the store."""


def _loose(kind: DataType) -> DataType:
    """The type with nulls allowed everywhere: what Parquet files of many writers have in common."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _loose(f.dataType), True) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(_loose(kind.elementType), True)
    return MapType(_loose(kind.keyType), _loose(kind.valueType), True) if isinstance(kind, MapType) else kind


def united(store: StructType | None, new: StructType) -> StructType:
    """Columns of the store after an append of rows of columns new; SchemaClash if there are none."""
    out = {} if store is None else {f.name.lower(): f for f in store}
    for f in _loose(new):
        old = out.setdefault(f.name.lower(), f)
        types = [old.dataType.simpleString(), f.dataType.simpleString()]
        if old.dataType != f.dataType and not any(set(types) <= set(w) and w.index(types[1]) < w.index(types[0]) for w in WIDER):
            raise SchemaClash(f"column {f.name} is {types[0]} in the store, {types[1]} in the append")
    return StructType(list(out.values()))


def tier_of(size: int, small: int, fanout: int) -> int:
    """The power of fanout that size is of small, 0 below."""
    tier = 0
    while size >= small * fanout ** (tier + 1):
        tier += 1
    return tier


class ShardTable:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, small: int = SMALL, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.small, self.fanout = spark, root, target, small, fanout
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{root}/manifests"))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n.split("-")[1]) for n in names if n.startswith("manifest-")), default=0)

    def _load(self, version: int | None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"runs": [], "columns": None}
        f = self._fs.open(self._path(f"{self.root}/manifests/manifest-{version:08d}"))
        try:
            return json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def manifest(self, version: int | None = None) -> list[dict]:
        return self._load(version)["runs"]

    def columns(self, version: int | None = None) -> StructType | None:
        """Columns of a version; none before the first commit."""
        found = self._load(version)["columns"]
        return found and StructType.fromJson(found)

    def _commit(self, base: int, runs: list[dict], columns: StructType) -> bool:
        """True if this call made version base + 1."""
        gateway, jvm = self.spark.sparkContext._gateway, self.spark._jvm
        beside = self._path(f"{self.root}/manifests/.new-{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps({"version": base + 1, "columns": columns.jsonValue(), "runs": runs}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(beside, self._path(f"{self.root}/manifests/manifest-{base + 1:08d}"), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(beside, False)
            return False
        return True

    def _write(self, df: DataFrame) -> dict | None:
        name = f"run-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/runs/{name}")
        files = [s.getLen() for s in self._fs.listStatus(self._path(f"{self.root}/runs/{name}")) if s.getPath().getName().startswith("part-")]
        size = sum(files)
        return {"name": name, "bytes": size, "files": len(files), "tier": tier_of(size, self.small, self.fanout)}

    def append(self, df: DataFrame) -> int:
        """Commits the rows of df as a run; the new version."""
        known = self.columns()
        columns = united(known, df.schema)
        types = {f.name.lower(): f for f in columns}
        run = self._write(df.select(*[F.col(f"`{c.replace('`', '``')}`").cast(types[c.lower()].dataType).alias(types[c.lower()].name) for c in df.columns]))
        if self._rows([run], columns).isEmpty():
            return self.version()
        while True:
            base = self.version()
            now = self.columns(base)
            if now != known:  # another writer's columns: the run's types must be those of the store as they stand
                clash = [f.name for f in now if types.get(f.name.lower(), f).dataType != f.dataType]
                if clash:
                    self._remove([run["name"]])
                    raise SchemaClash(f"columns {clash} got another type while this append was written; append again")
                columns = united(now, columns)
            if self._commit(base, [*self.manifest(base), run], columns):
                return base + 1

    def _rows(self, runs: list[dict], columns: StructType) -> DataFrame:
        return self.spark.read.schema(columns).parquet(*[f"{self.root}/runs/{r['name']}" for r in runs])

    def _remove(self, runs: list[str]) -> None:
        for name in runs:
            self._fs.delete(self._path(f"{self.root}/runs/{name}"), True)

    def compact(self) -> int:
        """Merges tiers until none holds fanout runs; the newest version."""
        while True:
            base = self.version()
            runs = self.manifest(base)
            full = [t for t in sorted({r["tier"] for r in runs}) if sum(r["tier"] == t for r in runs) >= self.fanout]
            if not full:
                return base
            old = [r for r in runs if r["tier"] == full[0]]
            size = sum(r["bytes"] for r in old)
            columns = self.columns(base)
            new = self._write(self._rows(old, columns).coalesce(max(1, math.ceil(size / self.target))))
            new["tier"] = max(new["tier"], full[0] + 1)
            if not self._commit(base, [*(r for r in runs if r not in old), new], columns):
                self._remove([new["name"]])

    def vacuum(self, versions: int = 1) -> list[str]:
        """Removes the runs that older manifests name and none of the newest few does; their names."""
        newest = self.version()
        named = [{r["name"] for r in self.manifest(v)} for v in range(1, newest + 1)]
        gone = sorted(set().union(*named[:-versions]) - set().union(*named[-versions:]))
        self._remove(gone)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version and their places; see the module's docstring."""
        runs = self.manifest(version)
        if not runs:
            return self.spark.createDataFrame([], "__run int, __shard int")
        place = F.create_map(*[F.lit(x) for i, r in enumerate(runs) for x in (r["name"], i)])
        df = self._rows(runs, self.columns(version))
        run, shard = free(df.columns, "__run", "__shard")
        path = F.input_file_name()
        return df.withColumns({run: place[F.regexp_extract(path, r"/(run-[0-9a-f]+)/", 1)], shard: F.regexp_extract(path, r"part-(\d+)", 1).cast("int")})


ARRIVALS = 4


def shard_documents(docs: DataFrame, arrivals: int = ARRIVALS) -> DataFrame:
    """(doc_id, version, run, shard) of every row of docs after it arrived in waves, by hash of doc_id, and was compacted."""
    spark = docs.sparkSession
    store = ShardTable(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}/shards")
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k))
        version = store.compact()
        store.vacuum()
    if not version:
        return spark.createDataFrame([], "doc_id long, version long, run int, shard int")
    placed = store.read(version)
    run, shard = placed.columns[-2:]
    return placed.select(F.col("doc_id").cast("long"), F.lit(version).cast("long").alias("version"), F.col(run).alias("run"), F.col(shard).alias("shard"))
