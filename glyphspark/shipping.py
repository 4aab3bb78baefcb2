"""Makes this package importable in Spark's Python workers, and bounds what they hold at once."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch where the session leaves Spark's default: rows of long texts then come in small batches.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b")


def bound_batches(spark: SparkSession) -> None:
    key, default, ours = BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, ours)


def ship(spark: SparkSession) -> None:
    """Sends the package to all executors with Spark's own file distribution, once for each application."""
    bound_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(Path(root.name) / p.relative_to(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
