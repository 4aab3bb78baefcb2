"""Versions of a table as manifest files, committed by a rename that never overwrites.

A manifest is a small JSON object in <root>/manifests/manifest-<version>. It is written beside and renamed to its name; of
two writers of one version the rename lets one through. Works on any file system that Hadoop can reach and rename on.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a temporary folder
    serves local masters (one machine); on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/glyphspark"


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{root}/manifests"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("manifest-"))

    def newest(self) -> int:
        """The newest version, 0 before the first commit."""
        return max(self.versions(), default=0)

    def load(self, version: int) -> dict:
        f = self._fs.open(self._path(f"{self.root}/manifests/manifest-{version:08d}"))
        try:
            return json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def commit(self, version: int, content: dict) -> bool:
        """True if this call made the version, False if another writer had made it."""
        jvm = self.spark._jvm
        beside = self._path(f"{self.root}/manifests/.new-{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        uri = beside.toUri() if beside.toUri().getScheme() else self._fs.getUri()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self._conf)
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, self._path(f"{self.root}/manifests/manifest-{version:08d}"), never)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(beside, False)
            return False
        return True

    def files(self, folder: str) -> list[str]:
        """Names of the data files that Spark wrote to a folder under the root."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.getPath().getName().startswith("part-"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
