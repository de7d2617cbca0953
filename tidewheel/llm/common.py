"""Shared helpers: written intermediate tables, words, hashing and components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes to lower-case word bytes; every separator becomes a blank. Bytes from
#: 0x80 up are word bytes, so working on UTF-8 gives the words of
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
WORD_TABLE = bytes(
    (b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
LETTER = re.compile(r"[^\W\d_]")
#: Rows per Arrow batch handed to Python: a batch of very long texts must fit.
BATCH_ROWS = 512

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: ``spark.checkpoint.dir``. Where that is unset, an own one, but only if all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base:
        return f"{base.rstrip('/')}/{app}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors reach: intermediate tables are written there.")
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="tidewheel-")
        atexit.register(shutil.rmtree, _own_dir[app], ignore_errors=True)
    return f"file://{_own_dir[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


class Bucketed:
    """A written table in buckets of one key: joins on that key don't shuffle it. ``drop`` deletes it."""

    def __init__(self, df: DataFrame, name: str, key: str) -> None:
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        self.name = f"{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.write.format("parquet").option("compression", "zstd").option("path", self.path)
        rows.bucketBy(buckets, key).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, for texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text as UTF-8 bytes; none for a null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def in_training(doc_id: str = "doc_id"):
    """False for held-out rows: crc32 of the id as text, modulo 4, is 2. A null id trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def held_out(doc_id: str = "doc_id"):
    return ~in_training(doc_id)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class WordHasher:
    """64-bit hashes of all words of a batch of texts, without a Python loop over words."""

    def __init__(self, seed: int = 7, limit: int = 1 << 20) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._grow(limit)

    def _grow(self, n: int) -> None:
        self.limit = n
        self.power, self.unpower = np.ones(n, np.uint64), np.ones(n, np.uint64)
        self.power[1:] = self.base
        self.unpower[1:] = self.inverse
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.unpower, out=self.unpower)

    def of(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in order, and the number of words in each text."""
        joined = b" ".join(data) + b" "
        if len(joined) > self.limit:
            self._grow(len(joined))
        raw = np.frombuffer(joined.translate(WORD_TABLE), np.uint8)
        inside = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        h = self.of_spans(raw, start, end)
        bounds = np.cumsum([0] + [len(x) + 1 for x in data])
        return h, np.diff(np.searchsorted(start, bounds))

    def of_spans(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each start to its end."""
        if len(raw) > self.limit:
            self._grow(len(raw))
        total = np.cumsum(self.table[raw] * self.power[: len(raw)])
        before = np.where(start > 0, total[start - 1], 0).astype(np.uint64)
        return mix64((total[end - 1] - before) * self.unpower[start])


def chunks_of(data: list, size=len, limit: int = 1 << 20):
    """Ranges (from, to) over data of about ``limit`` units each, one item at least."""
    i, n = 0, len(data)
    while i < n:
        j, total = i, 0
        while j < n and (j == i or total + size(data[j]) <= limit):
            total += size(data[j])
            j += 1
        yield i, j
        i = j


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (v, c), c the smallest vertex reached.

    Minimum labels spread over the edges and are then shortened by pointer
    jumping, until nothing changes; each round is a written table. Labels stay
    distributed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("m"))
        new = labels.join(near, labels["v"] == near["a"]).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        new = materialize(new, "spread")
        up = new.select(F.col("v").alias("u"), F.col("c").alias("up"))
        new = new.join(up, new["c"] == up["u"], "left").select("v", "old", F.least("c", F.coalesce("up", "c")).alias("c"))
        new = materialize(new, "labels")
        labels = new.select("v", "c")
        if new.where("c <> old").limit(1).count() == 0:
            return labels


def lookup(left: DataFrame, right: DataFrame, key: str, uses: str, hot: int = 1000) -> DataFrame:
    """Left join to a table with one row a key, whose ``uses`` counts the left rows of that key.

    Keys with over 1/``hot`` of all rows are fewer than ``hot``: they are
    joined by a broadcast, and their rows, spread by a hash of the left side's
    numbers, meet nothing in the shuffle join of the rest, in which no key is
    large. The left side is read once.
    """
    total = right.agg(F.sum(uses)).first()[0] or 0
    numbers = [c for c, t in left.dtypes if t in ("bigint", "int", "boolean")]
    payload = [c for c in right.columns if c != key]
    named = lambda df, mark: df.select(F.col(key).alias(f"_key{mark}"), *[F.col(c).alias(f"_{mark}_{c}") for c in payload])
    many = named(right.where(F.col(uses) * hot > total), "m")
    few = named(right.where(F.col(uses) * hot <= total), "f").withColumn("_zero", F.lit(0))
    out = left.join(F.broadcast(many), F.col(key) == F.col("_keym"), "left")
    cold = F.col("_keym").isNull() & F.col(key).isNotNull()
    out = out.withColumn("_cold", F.when(cold, F.col(key)))
    out = out.withColumn("_salt", F.when(cold, 0).otherwise(F.pmod(F.xxhash64(*(numbers or [F.lit(0)])), F.lit(9973)).cast("int") + 1))
    out = out.join(few, (F.col("_cold") == F.col("_keyf")) & (F.col("_salt") == F.col("_zero")), "left")
    return out.select(*left.columns, *[F.coalesce(f"_m_{c}", f"_f_{c}").alias(c) for c in payload])
