"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import bpe, default_paths

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity), placed in the given order.

    Each item goes where the sum over gaps g of (open bins with gap g) squared
    becomes smallest; full bins don't count, a new bin is one of the choices,
    ties go to the smallest gap that fits. The items of one length that come
    in a row are placed one by one, as any others.
    """
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fresh = 0
    for k, size in enumerate(lengths.tolist()):
        if size == capacity:
            bins[k], offsets[k], fresh = fresh, 0, fresh + 1
            continue
        # Taking gap g: -2 count[g] + 1 + (2 count[g - size] + 1, or 0 for a gap filled wholly).
        after = 2 * count[: capacity - size + 1] + 1
        after[0] = 0
        change = after - 2 * count[size:] + 1
        change[-1] = after[-1]  # a new bin leaves no gap class
        change[:-1][count[size:-1] == 0] = 1 << 40
        at = int(change.argmin()) + size
        if at == capacity:
            b, fresh = fresh, fresh + 1
        else:
            b = open_bins[at].pop()
            count[at] -= 1
        bins[k], offsets[k] = b, capacity - at
        left = at - size
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, offsets


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones from the end, so that only the first may be shorter."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    starts = ([0] if first else []) + list(range(first, total, capacity))
    return [(s, (starts + [total])[i + 1] - s) for i, s in enumerate(starts)]


def tokenised_pieces(
    docs: DataFrame, capacity: int, tokenizer: str, ranks: str | None, end_id: int
) -> DataFrame:
    """A row per piece of each document's ids; every document gets ``end_id`` at its end, so none is empty."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(tokenizer, ranks)
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            doc_ids = batch.column(0).to_pylist()
            for i, j in common.chunks_of(texts, lambda t: len(t or ""), 1 << 22):
                for doc_id, ids in zip(doc_ids[i:j], encoder.encode(texts[i:j])):
                    ids = np.append(ids, np.uint32(end_id))
                    for k, (s, size) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc_id, k, s, size, common.crc_of(ids[s : s + size])))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    tokenizer: str | None = None,
    ranks: str | None = None,
    end_id: int = 0,
    shard_rows: int = 60_000,
) -> DataFrame:
    """Pack all documents' pieces into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Pieces of full length are sequences by themselves.
    The others are dealt by row number, whatever their key, into shards of
    about ``shard_rows``, each packed in one task by the sum-of-squares rule,
    long pieces first; a shard leaves a few bins open, so the loss is a few
    sequences a shard. The pieces are a written table, so a shard that runs
    again gets the same rows.

    Null text counts as empty (one sequence place for ``end_id``); null and
    repeated doc_ids are kept as they are, a row each; an empty table gives an
    empty result; other columns are ignored.
    """
    if tokenizer is None:
        tokenizer, ranks = default_paths()
    pieces = common.materialize(tokenised_pieces(docs, capacity, tokenizer, ranks, end_id), "pieces")
    shards = max(1, round(pieces.where(F.col("length") < capacity).count() / shard_rows))
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == capacity).select(
        *pieces.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    def place(pdf):
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = bins * shards + pdf["shard"].to_numpy()
        pdf["offset"] = offsets
        return pdf.drop(columns=["row", "shard"])

    part = numbered.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    placed = part.groupBy("shard").applyInPandas(place, PIECES + ", sequence_id long, offset long")
    return full.unionByName(placed)
