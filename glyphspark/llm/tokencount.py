"""Operator 8, token counts through a digest cache.

Contract of `token_counts`: every row comes back with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit). A null
text counts as empty: 0 bytes, 0 tokens. The count is that of the tokenizer library for the whole text, without added
tokens, truncation or padding; special strings inside a text are handled as the library does by default. Repeated rows
and texts are encoded once. Extra columns are ignored.

The cache is a Parquet table (digest, tokenizer, n_tokens): sha-256 of the normalised text (null becomes empty; byte-level
encoding forbids any other change) and the digest of the tokenizer file. No text is shuffled: digests are grouped and
joined, and of each missing one a single physical row, the first by file and place in it, is chosen and encoded where it
lies. The places chosen are bitmaps of 4 KB for each 32768 rows of a file, one bit a row, which are joined to the scan by
broadcast. Files are dealt by name into as many rounds as keep the bitmaps of a round under ROUND_BYTES; a file is scanned
in its round only. The counts of a round are appended as they are ready, so a run that fails goes on from there. Where docs
are not read from files, they are written to the shared folder first. A digest that is repeated by a third of all rows is
one row after partial aggregation; digests of 1 / HOT of all rows or more, of which there are HOT at most, get their counts
by broadcast, the others by shuffle.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, shared_dir

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
#: Most digests whose counts are broadcast; bytes of bitmaps that are in a round.
HOT, ROUND_BYTES = 256, 64 << 20
CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"

_loaded: dict[str, object] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer, kept for the life of a Python worker; no truncation or padding."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def cut_points(text: str, most: int) -> list[int]:
    """Places to cut a very long text where the byte-level pattern always ends a piece: before a single space that
    stands between two ASCII letters and outside of special strings. Counts of the parts then add up to the whole's."""
    cuts, at = [0], most
    while at < len(text):
        k = at
        while k < len(text) - 1 and not (text[k] == " " and text[k - 1].isascii() and text[k - 1].isalpha() and text[k + 1].isascii() and text[k + 1].isalpha()):
            k += 1
        if k >= len(text) - 1:
            break
        cuts.append(k)
        at = k + most
    return [*cuts, len(text)]


def count_texts(texts: list[str], path: str, most: int = 200_000) -> list[int]:
    """Token counts of whole texts. Texts over most characters go in parts, so memory stays bounded."""
    t = load(path)
    out = []
    for text in texts:
        if len(text) <= most:
            out.append(len(t.encode(text, add_special_tokens=False).ids))
        else:
            cuts = cut_points(text, most)
            out.append(sum(len(t.encode(text[a:b], add_special_tokens=False).ids) for a, b in zip(cuts, cuts[1:], strict=False)))
    return out


def encode_missing(rows: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) for rows (digest, text)."""

    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count_texts(texts, path), pa.int64())], names=["digest", "n_tokens"])

    return rows.select("digest", "text").mapInArrow(encode, "digest string, n_tokens long")


class TokenCache:
    """The stored counts. Appending twice is harmless: readers take one row for each digest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            spark.read.schema(CACHE_SCHEMA).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)

    def read(self, tokenizer: str) -> DataFrame:
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).where(F.col("tokenizer") == tokenizer)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame, tokenizer: str) -> None:
        rows.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(self.path)


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, path, row) of docs: the file of each row and its place there. Rows that come from no file are written
    to one first."""
    for frame in (docs, None):
        frame = durable(docs.select("doc_id", "text"), "texts") if frame is None else frame
        try:
            place = frame.metadataColumn("_metadata")
            found = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place["file_path"].alias("path"), place["row_index"].alias("row"))
            found.schema  # noqa: B018 - the analysis fails here where there are no files
            return found
        except AnalysisException:
            pass
    raise ValueError("docs have no files")


def encode_chosen(placed: DataFrame, chosen: DataFrame, cache: "TokenCache", path: str, name: str) -> None:
    """Encodes the rows of placed whose (file, row) is in chosen (file: hash of the path), in rounds of files."""
    marks = chosen.groupBy("file", F.expr("row div 32768").alias("block")).agg(F.bitmap_construct_agg(F.col("row") % 32768).alias("bits"))
    marks = durable(marks, "marks")
    rounds = max(1, -(-marks.count() * 4096 // ROUND_BYTES))
    for k in range(rounds):
        rows = placed.withColumn("file", F.xxhash64("path"))
        some = marks
        if rounds > 1:
            rows, some = (x.where(F.pmod("file", F.lit(rounds)) == k) for x in (rows, marks))
        met = rows.join(F.broadcast(some), (rows["file"] == some["file"]) & (F.expr("row div 32768") == F.col("block")))
        byte = F.conv(F.hex(F.substring("bits", (F.col("row") % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = met.where(F.getbit(byte, (F.col("row") % 8).cast("int")) == 1)
        cache.append(encode_missing(found.select(F.sha2("text", 256).alias("digest"), "text"), path), name)
    discard(marks)


def token_counts(docs: DataFrame, cache_path: str | None = None, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """See the module's docstring. Without cache_path the cache starts empty, in the shared folder."""
    import uuid

    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    cache = TokenCache(spark, cache_path or f"{shared_dir(spark)}/{uuid.uuid4().hex}/token-cache")
    name = version(path)
    placed = _placed(docs)
    light = durable(placed.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("path").alias("file"), "row"), "digests")
    seen = durable(light.groupBy("digest").agg(F.min(F.struct("file", "row")).alias("first"), F.count("*").alias("n")), "distinct")
    missing = durable(seen.join(cache.read(name).select(F.col("digest").alias("d")), F.col("digest") == F.col("d"), "left_anti").select("first.*"), "missing")
    n_rows, n_missing = light.count(), missing.count()
    if n_missing:
        encode_chosen(placed, missing, cache, path, name)
    counts = cache.read(name)
    often = seen.where(F.col("n") >= F.lit(max(2, -(-n_rows // HOT)))).select(F.col("digest"))
    often = durable(often.join(counts, "digest").select("digest", F.col("n_tokens").alias("often")), "often")
    discard(seen, missing)
    marked = light.join(F.broadcast(often), "digest", "left")
    rare = marked.where("often is null").drop("often").join(counts, "digest")
    rows = marked.where("often is not null").withColumnRenamed("often", "n_tokens").unionByName(rare)
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
