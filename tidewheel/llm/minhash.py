"""MinHash near-duplicates by a containment ensemble over partitions of the shingle-set size."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PERMUTATIONS = 128
SIGNED = "doc_id long, text_key binary, set_key binary, n_shingles long, bands array<long>"


def shingle_sets(data: list[bytes], hasher: common.WordHasher, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text; a text of fewer words, but not none, is one shingle."""
    out: list[np.ndarray] = []
    for i, j in common.chunks_of(data):
        h, counts = hasher.of(data[i:j])
        rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k] if len(rolled) else rolled
        rolled = common.mix64(rolled)
        at = 0
        for c in counts.tolist():
            if c >= n:
                out.append(np.unique(rolled[at : at + c - n + 1]))
            elif c:
                short = np.uint64(c)
                for w in h[at : at + c]:
                    short = common.mix64(np.array([short * np.uint64(3) + w]))[0]
                out.append(np.array([short], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += c
    return out


def signatures(sets: list[np.ndarray], count: int = PERMUTATIONS, seed: int = 17) -> np.ndarray:
    """MinHash signatures (sets by permutations) of non-empty sets, 32 bits each."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)
    flip = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)
    out = np.empty((len(sets), count), np.uint32)
    for i, j in common.chunks_of(sets, len, 1 << 15):
        x = np.concatenate(sets[i:j])
        low, high = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        for p in range(count):
            v = (low ^ flip[p]) * mul[p]
            v += high * (add[p] | np.uint32(1))
            v ^= v >> np.uint32(15)
            out[i:j, p] = np.minimum.reduceat(v, starts)
    return out


def partition_of(size: int) -> int:
    """Size partitions with a ratio of two."""
    return size.bit_length() - 1


def jaccard_bound(partition: int, containment: float) -> float:
    """The least Jaccard similarity of two sets, the larger in this partition, each containing that share of the larger.

    With sizes x <= y the overlap is at least ceil(t y), so J >= o / (x + y - o);
    sets with x < t y can't reach it. Small sizes are enumerated, larger ones
    approach t / (2 - t).
    """
    low, high = 1 << partition, (2 << partition) - 1
    if low > 64:
        return containment / (2 - containment)
    least = 1.0
    for y in range(low, high + 1):
        o = math.ceil(containment * y - 1e-9)
        for x in range(o, y + 1):
            least = min(least, o / (x + y - o))
    return least


def tune(similarity: float, count: int = PERMUTATIONS, miss: float = 1e-3) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, at which a pair at the bound is missed with ``miss`` at most."""
    for rows in range(16, 0, -1):
        if similarity >= 1:
            return 1, rows
        bands = math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))
        if bands * rows <= count:
            return bands, rows
    return count, 1


class Ensemble:
    """Band keys of a set in each partition in which it may meet a near-duplicate."""

    def __init__(self, containment: float) -> None:
        self.containment = containment
        self.bands = {p: tune(jaccard_bound(p, containment)) for p in range(40)}

    def keys(self, size: int, signature: np.ndarray) -> list[int]:
        """A set joins its own partition, and that of the largest set it may be contained in."""
        out: list[np.ndarray] = []
        for p in {partition_of(size), partition_of(int(size / self.containment + 1e-9))}:
            bands, rows = self.bands[p]
            block = signature[: bands * rows].reshape(bands, rows).astype(np.uint64)
            h = np.full(bands, (p + 1) * 0x9E3779B1, np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            for r in range(rows):
                h = common.mix64(h * np.uint64(0xD6E8FEB86659FD93) + block[:, r])
            out.append(h)
        return np.concatenate(out).view(np.int64).tolist()


def sign(docs: DataFrame, containment: float, shingle: int) -> DataFrame:
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ensemble = common.WordHasher(), Ensemble(containment)
        for b in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            sets = shingle_sets(data, hasher, shingle)
            full = [k for k, s in enumerate(sets) if len(s)]
            sigs = signatures([sets[k] for k in full])
            bands: list[list[int]] = [[] for _ in data]
            for k, sig in zip(full, sigs):
                bands[k] = ensemble.keys(len(sets[k]), sig)
            keys = [hashlib.md5(s.tobytes()).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "set_key", "n_shingles", "bands"],
            )

    text_key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.select(F.col("doc_id").cast("long"), "text", text_key.alias("text_key")).mapInArrow(run, SIGNED)


def verify(pairs: DataFrame, texts: DataFrame, containment: float, shingle: int) -> DataFrame:
    """Of candidate pairs (a, b) of sets, those that share ``containment`` of the larger set, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.WordHasher()
        for b in batches:
            ones, twos = b.column(2).to_pylist(), b.column(3).to_pylist()
            distinct = list(dict.fromkeys([*ones, *twos]))
            made = shingle_sets([t.encode("utf-8", "surrogatepass") for t in distinct], hasher, shingle)
            at = dict(zip(distinct, made))
            ok = []
            for x, y in zip(ones, twos):
                s, t = at[x], at[y]
                ok.append(len(np.intersect1d(s, t, assume_unique=True)) >= containment * max(len(s), len(t)) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    one = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, containment: float = 0.8, shingle: int = 5, rounds: int = 4) -> DataFrame:
    """Near-duplicate class of every document.

    Two texts link if each of their shingle sets holds ``containment`` of the
    larger one: containment both ways, for a small text that many large ones
    quote would else merge these. Returns doc_id, text_key, class_id (the
    smallest doc_id of the class), class_size, n_shingles and kept (the row
    that stays: smallest doc_id, then text). Texts with equal shingle sets are
    one class from the start. Null and empty texts, and those without words,
    link with nothing. Rows with null doc_ids come last in a class; class_id
    is null if all are; equal rows (doc_id and text) are kept alike.

    In each bucket all members are tested against its leader; then leaders
    leave, and buckets in which unlinked members remain get another leader,
    for ``rounds`` rounds. What still is in one bucket, but not in one class,
    is compared pair by pair, so no candidate is lost and tight groups of any
    size need no more than a test a member.
    """
    spark = docs.sparkSession
    signed = common.materialize(sign(docs, containment, shingle), "signed")
    sets = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("text_key").alias("text_key"), F.first("bands").alias("bands"))
    rows = sets.select("set_key", "text_key", F.explode(F.array_distinct("bands")).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = common.materialize(rows.join(shared, "key"), "buckets")
    wanted = buckets.groupBy("set_key").agg(F.first("text_key").alias("text_key"))
    by_key = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text").where("text is not null")
    texts = by_key.join(wanted, "text_key").groupBy("set_key").agg(F.first("text").alias("text"))
    texts = common.materialize(texts, "texts")

    left = buckets.select("key", F.col("set_key").alias("m"))
    links, labels = None, None
    for turn in range(rounds + 1):
        if labels is None:
            left = left.withColumn("c", F.col("m"))
        else:
            left = left.select("key", "m").join(labels, F.col("m") == F.col("v"), "left").select("key", "m", F.coalesce("c", "m").alias("c"))
            mixed = left.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
            left = common.materialize(left.join(mixed, "key"), "mixed")
            if not left.limit(1).count():
                break
        if turn < rounds:
            leader = left.groupBy("key").agg(F.min(F.struct("m", "c")).alias("lead"))
            met = left.join(leader, "key")
            pairs = met.where("m <> lead.m and c <> lead.c").select(F.col("lead.m").alias("a"), F.col("m").alias("b"))
            left = met.where("m <> lead.m").select("key", "m")
        else:
            other = left.select("key", F.col("m").alias("a"), F.col("c").alias("ca"))
            pairs = left.join(other, "key").where("a < m and c <> ca").select("a", F.col("m").alias("b"))
        found = common.materialize(verify(pairs.distinct(), texts, containment, shingle), "links")
        if turn and not found.limit(1).count():
            continue
        links = found if links is None else links.unionByName(found)
        labels = common.components(links)

    signed = signed.withColumn("class", F.when(F.col("n_shingles") > 0, F.col("set_key")))
    if labels is not None:
        sizes = signed.groupBy("set_key").agg(F.count("*").alias("uses"))
        moved = labels.withColumnRenamed("v", "set_key").join(sizes, "set_key")
        signed = common.lookup(signed, moved, "set_key", "uses").withColumn("class", F.coalesce("c", "class"))
    lone = signed.where("class is null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = signed.where("class is not null").groupBy("class").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    done = common.lookup(signed.where("class is not null"), least, "class", "class_size")
    cols = ["doc_id", "text_key", "n_shingles"]
    return done.select(
        *cols,
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"),
    ).unionByName(lone.select(*cols, F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")))
