"""Token-id shards in training order: a keyed permutation gives every sequence its place."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import bpe, default_paths

SEQUENCE = "part int, number long, ids binary, n_tokens int, doc_ids array<long>, doc_starts array<long>, places array<int>"
RESULT = (
    "slot long, shard long, shard_row int, n_tokens int, ids_crc32 long,"
    " doc_ids array<long>, doc_starts array<long>, places array<int>"
)


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next power of four, walked until below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = common.mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    out = np.array(index, dtype=np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (common.mix64(right ^ k) & mask)
        x = (left << shift) | right
        out[walking] = x
        walking = walking[x >= np.uint64(n)]
    return out.astype(np.int64)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _commit(uri: str, data: bytes) -> None:
    """Write under another name, then rename: a reader never sees half a file, and a second attempt writes the same."""
    where, path = _open(uri)
    mark = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    with where.open_output_stream(f"{path}.{mark}.tmp") as f:
        f.write(data)
    where.move(f"{path}.{mark}.tmp", path)


def sequences(docs: DataFrame, length: int, tokenizer: str, ranks: str | None, end_id: int) -> DataFrame:
    """Each task's documents, end to end, cut into sequences; only a task's last one is shorter than ``length``."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(tokenizer, ranks)
        part = TaskContext.get().partitionId()
        waiting: list[np.ndarray] = []
        spans: list[list[int]] = []  # doc_id, start in the document, length
        held = number = 0

        def cut(everything: bool) -> list[tuple]:
            nonlocal waiting, spans, held, number
            if not held:
                return []
            ids = np.concatenate(waiting)
            rows, at = [], 0
            while held - at >= length or (everything and at < held):
                size = min(length, held - at)
                members, fill = [], 0
                while fill < size:
                    doc_id, start, left = spans[0]
                    take = min(left, size - fill)
                    members.append((doc_id, start, fill))
                    spans[0] = [doc_id, start + take, left - take]
                    if take == left:
                        spans.pop(0)
                    fill += take
                rows.append((part, number, ids[at : at + size].astype("<u2").tobytes(), size, *map(list, zip(*members))))
                number, at = number + 1, at + size
            waiting, held = [ids[at:]], held - at
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            names = ["part", "number", "ids", "n_tokens", "doc_ids", "doc_starts", "places"]
            cols = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in common.chunks_of(texts, lambda t: len(t or ""), 1 << 22):
                for doc_id, ids in zip(doc_ids[i:j], encoder.encode(texts[i:j])):
                    if len(ids) and int(ids.max()) > 65535:
                        raise ValueError("ids above 65,535 don't fit the shards' 16 bits: take another vocabulary")
                    waiting.append(np.append(ids, np.uint32(end_id)))
                    spans.append([doc_id, 0, len(ids) + 1])
                    held += len(ids) + 1
                yield batch_of(cut(False))
        yield batch_of(cut(True))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SEQUENCE)


def frequent_first(staged: DataFrame) -> np.ndarray:
    """All 16-bit ids, those most frequent in the first 256 sequences (2048 ids of each) first. It only makes bundles smaller."""
    rows = staged.select(F.substring("ids", 1, 4096).alias("ids")).limit(256).collect()
    ids = np.frombuffer(b"".join(r["ids"] for r in rows), "<u2")
    return np.argsort(-np.bincount(ids, minlength=1 << 16), kind="stable").astype("<u2")


def squeeze(ids: np.ndarray, rank: np.ndarray, compressor: zstandard.ZstdCompressor) -> bytes:
    """Compress the ids' ranks, high bytes before low ones: most high bytes are alike."""
    return compressor.compress(rank[ids].view(np.uint8).reshape(-1, 2)[:, ::-1].T.tobytes())


def unsqueeze(data: bytes, order: np.ndarray, decompressor: zstandard.ZstdDecompressor) -> np.ndarray:
    high, low = np.frombuffer(decompressor.decompress(data), np.uint8).reshape(2, -1).astype("<u2")
    return order[high << 8 | low]


def write_shards(
    docs: DataFrame,
    out: str | None = None,
    length: int = 2048,
    shard_sequences: int = 4096,
    key: int = 20240229,
    tokenizer: str | None = None,
    ranks: str | None = None,
    end_id: int = 0,
) -> DataFrame:
    """Tokenise whole documents into sequences and write them in a keyed random order.

    Every document's ids end with ``end_id``; a task's documents follow each
    other, cut every ``length`` ids. Sequence i of n goes to slot
    ``feistel(i, n, key)``; slot s is record ``s % shard_sequences`` of shard
    ``s // shard_sequences``. Records are ``length`` little-endian 16-bit ids,
    padded with ``end_id``, so reads of any slot range are one seek; the
    ``.json`` beside a shard has its real lengths and documents, and
    ``manifest.json`` the geometry. Ids above 65,535 are an error.

    Returns, from the files as read back, a row per sequence: slot, shard,
    shard_row, n_tokens, ids_crc32 (of the real ids) and, in order, the
    documents in it: doc_ids, doc_starts (id offset in the document), places
    (offset in the sequence). Null text counts as empty; null and repeated
    doc_ids stay; an empty table writes the manifest only; other columns, of
    any name, are ignored; texts of any length are cut over as many sequences
    as they need.
    """
    if not 0 <= end_id <= 65535:
        raise ValueError("end_id doesn't fit 16 bits")
    if tokenizer is None:
        tokenizer, ranks = default_paths()
    spark = docs.sparkSession
    out = out or common.new_path(spark, "shards")
    staged = common.materialize(sequences(docs, length, tokenizer, ranks, end_id), "sequences")
    per_part = staged.groupBy("part").count()
    base = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per_part = per_part.select("part", F.coalesce(base, F.lit(0)).alias("base"))
    if per_part.count() <= 1_000_000:  # a row a task, 16 bytes each; beyond that the join shuffles
        per_part = F.broadcast(per_part)
    n = staged.count()
    order = frequent_first(staged)
    rank = np.argsort(order).astype("<u2")
    _open(out)[0].create_dir(_open(out)[1], recursive=True)
    _commit(f"{out}/manifest.json", json.dumps({"sequences": n, "length": length, "shard_sequences": shard_sequences, "dtype": "<u2", "pad_id": end_id, "key": key}).encode())

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Join the sequences of a batch that go to one shard, and compress them together."""
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            d = batch.to_pydict()
            slots = feistel(np.array(d["index"], np.int64), n, key)
            groups: dict[int, list[int]] = {}
            for k, s in enumerate((slots // shard_sequences).tolist()):
                groups.setdefault(s, []).append(k)
            meta, data = [], []
            for ks in groups.values():
                meta.append(json.dumps([[int(slots[k]), d["n_tokens"][k], d["doc_ids"][k], d["doc_starts"][k], d["places"][k]] for k in ks]))
                data.append(squeeze(np.frombuffer(b"".join(d["ids"][k] for k in ks), "<u2"), rank, compressor))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(groups), pa.int64()), pa.array(meta, pa.string()), pa.array(data, pa.binary())], ["shard", "meta", "data"]
            )

    def write(pdf):
        import pandas as pd

        shard = int(pdf["shard"].iloc[0])
        rows = min(shard_sequences, n - shard * shard_sequences)
        records = np.full((rows, length), end_id, "<u2")
        index: list = [None] * rows
        decompressor = zstandard.ZstdDecompressor()
        for meta, data in zip(pdf["meta"], pdf["data"]):
            ids, at = unsqueeze(data, order, decompressor), 0
            for slot, size, *members in json.loads(meta):
                r = slot - shard * shard_sequences
                records[r, :size] = ids[at : at + size]
                index[r] = [size, *members]
                at += size
        _commit(f"{out}/shard-{shard:08d}.bin", records.tobytes())
        _commit(f"{out}/shard-{shard:08d}.json", json.dumps(index).encode())
        got = []
        for k, (ids, (size, *members)) in enumerate(read(out, shard * shard_sequences, rows)):
            got.append((shard * shard_sequences + k, shard, k, size, common.crc_of(ids), *members))
        return pd.DataFrame(got, columns=["slot", "shard", "shard_row", "n_tokens", "ids_crc32", "doc_ids", "doc_starts", "places"])

    indexed = staged.join(per_part, "part").select(
        (F.col("base") + F.col("number")).alias("index"), "ids", "n_tokens", "doc_ids", "doc_starts", "places"
    )
    bundled = indexed.mapInArrow(bundle, "shard long, meta string, data binary")
    return bundled.groupBy("shard").applyInPandas(write, RESULT)


def read(out: str, slot: int, count: int) -> Iterator[tuple[np.ndarray, list]]:
    """Sequences of a slot range in training order, each with [n_tokens, doc_ids, doc_starts, places]: one seek a shard."""
    where, path = _open(out)
    with where.open_input_file(f"{path}/manifest.json") as f:
        m = json.loads(f.read())
    stride, per = 2 * m["length"], m["shard_sequences"]
    end = min(slot + count, m["sequences"])
    while slot < end:
        shard, first = divmod(slot, per)
        rows = min(per - first, end - slot)
        with where.open_input_file(f"{path}/shard-{shard:08d}.json") as f:
            index = json.loads(f.read())
        with where.open_input_file(f"{path}/shard-{shard:08d}.bin") as f:
            f.seek(first * stride)
            ids = np.frombuffer(f.read(rows * stride), m["dtype"]).reshape(rows, m["length"])
        for k in range(rows):
            yield ids[k, : index[first + k][0]], index[first + k]
        slot += rows
