"""Helpers shared by the corpus operators: durable intermediate tables, text bytes, connected components."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a temporary folder
    serves local masters (one machine); on a cluster it is an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/glyphspark"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    weakref.finalize(out, _written.pop, id(out), None)
    return out


#: Path of each table of durable that is still in use.
_written: dict[int, str] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes tables that durable gave. Nothing read later may stand on them but what was written since."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_written[id(df)])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores put before it until no column has it, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id) -> "F.Column":
    """True for the fifth of documents that no model may learn from: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows evenly over tasks ahead of expensive per-row work when the scan has fewer tasks than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, *keys)


def gathered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows with equal keys in one task, sorted by keys and order, for functions that stream through them.

    The hash expression keeps the exchange: on the bare keys the planner drops it above a join on the same keys, and
    adaptive execution may then split a key's rows over tasks."""
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


#: Star steps at most: their number grows with the logarithm of the longest path.
STEPS = 100


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) with component = the smallest node reachable, for every node of edges (src, dst: long).

    Alternating large-star and small-star steps; each step only groups by node with partial sums (min), and a node's
    neighbours are never gathered in one row: the minimum comes from an aggregation and is joined back.
    Each step is written to the shared folder, so lineage stays short. Ends when a pass changes nothing.
    Empty edges give an empty table.
    """
    cur = durable(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), f"{name}-0")
    seen = None
    for step in range(1, STEPS + 1):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, cur = cur, durable(small, f"{name}-{step}")
        discard(last)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {STEPS} steps")
