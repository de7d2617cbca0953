"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark items."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean,"
    " items array<string>, spans array<array<int>>, contained array<string>, best_item string, best_containment double"
)
STEP = np.uint64(0xD6E8FEB86659FD93)


def rolled(h: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each size up to ``window``: hashes of all runs of so many words."""
    value = np.zeros(len(h), np.uint64)
    for n in range(1, window + 1):
        if len(h) < n:
            return
        value = value[: len(h) - n + 1] * STEP + h[n - 1 :]
        yield n, common.mix64(value + np.uint64(n))


class Tokens:
    """The distinct shingle hashes of a block of items; most others are sorted out by one look at a table of bits."""

    def __init__(self, codes: np.ndarray, sizes: list[int]) -> None:
        self.codes, self.sizes = codes, sizes
        self.shift = np.uint64(64 - max(10, int(len(codes) * 8).bit_length()))
        self.there: np.ndarray | None = None

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose value is a token, and the token's number."""
        if self.there is None:  # built where it is used
            self.there = np.zeros(1 << (64 - int(self.shift)), bool)
            self.there[(self.codes >> self.shift).astype(np.int64)] = True
        at = np.flatnonzero(self.there[(values >> self.shift).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.codes, values[at]), max(0, len(self.codes) - 1))
        same = self.codes[k] == values[at] if len(self.codes) else np.zeros(len(at), bool)
        return at[same], k[same]

    def matches(self, h: np.ndarray, counts: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, text, word place, token) of runs of words in the texts whose word hashes are given."""
        ends = np.cumsum(counts)
        for n, values in rolled(h, window):
            if n in self.sizes:
                at, token = self.find(values)
                text = np.searchsorted(ends, at, side="right")
                inside = at + n <= ends[text]
                at, token, text = at[inside], token[inside], text[inside]
                yield n, text, at - (ends[text] - counts[text]), token


@dataclass
class Found:
    """What stands in a text: number of words, hit word ranges, items with an occurring shingle, and contained items with their shares."""

    words: int
    spans: list[list[int]]
    items: list[str]
    contained: dict[str, float]

    def packed(self) -> str | None:
        return json.dumps([self.spans, self.items, self.contained]) if self.spans else None

    def join(self, packed: str | None) -> Found:
        if packed is None:
            return self
        spans, items, contained = json.loads(packed)
        return Found(self.words, _union(self.spans + spans), sorted({*self.items, *items}), contained | self.contained)


class Index:
    """The set join's item side, as arrays: shingles of ``window`` words (of all words, for shorter items), rarest first.

    ``frequency(tokens)`` gives how often each token occurs in the documents.
    An item with s distinct shingles needs ceil(t s) of them, so at least one
    of its s - ceil(t s) + 1 rarest, its prefix, stands in any window that
    contains it.
    """

    def __init__(self, items: list[tuple[str, str | None]], frequency: Callable[[Tokens], np.ndarray] | None, window: int, threshold: float) -> None:
        self.window, hasher = window, common.WordHasher()
        data = [b" ".join(common.words(t)) for _, t in items]
        keep = [k for k, x in enumerate(data) if x]
        self.names, data = [items[k][0] for k in keep], [data[k] for k in keep]
        self.blob = b" ".join(data) + b" "
        self.words = np.zeros(len(data), np.int64)
        codes, whose, first, last = [], [], [], []
        offset = 0
        for i, j in common.chunks_of(data):
            h, counts = hasher.of(data[i:j])
            self.words[i:j] = counts
            chunk = np.frombuffer(b" ".join(data[i:j]) + b" ", np.uint8)
            begin, end = np.flatnonzero(np.concatenate([[True], chunk[:-1] == 32])), np.flatnonzero(chunk == 32)
            item = np.repeat(np.arange(i, j), counts)
            place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
            for n, values in rolled(h, window):
                own = item[: len(values)]
                at = np.flatnonzero((np.minimum(self.words[own], window) == n) & (place[: len(values)] + n <= self.words[own]))
                codes.append(values[at])
                whose.append(own[at])
                first.append(begin[at] + offset)
                last.append(end[at + n - 1] + offset)
            offset += len(chunk)
        joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        codes, whose, first, last = joined(codes, np.uint64), joined(whose, np.int32), joined(first, np.int64), joined(last, np.int64)
        unique, token = np.unique(codes, return_inverse=True)
        self.tokens = Tokens(unique, sorted(set(np.minimum(self.words, window).tolist())))
        often = frequency(self.tokens) if frequency else np.zeros(len(unique), np.int64)
        # Distinct shingles of each item, rarest first. Equal hashes of unlike shingles in one item stay two entries: texts are compared.
        order = np.lexsort((first, token, often[token], whose))
        whose, token, first, last = whose[order], token[order], first[order], last[order]
        fresh = np.ones(len(order), bool)
        for k in np.flatnonzero((whose[1:] == whose[:-1]) & (token[1:] == token[:-1])).tolist():
            fresh[k + 1] = self.blob[first[k] : last[k]] != self.blob[first[k + 1] : last[k + 1]]
        whose, token, first, last = whose[fresh], token[fresh], first[fresh], last[fresh]
        self.size = np.bincount(whose, minlength=len(data))  # distinct shingles
        self.need = np.ceil(threshold * self.size - 1e-9).astype(np.int64).clip(1)
        rank = np.arange(len(whose)) - np.concatenate([[0], np.cumsum(self.size)])[whose]
        self.prefix = rank < self.size[whose] - self.need[whose] + 1
        order = np.argsort(token, kind="stable")
        self.entry = order.astype(np.int64)
        self.of = np.searchsorted(token[order], np.arange(len(unique) + 1))
        self.whose, self.first, self.last = whose, first, last

    def search(self, data: list[bytes], hasher: common.WordHasher) -> list[Found]:
        """All texts of a part at once; only texts with a shared shingle are looked at further."""
        h, counts = hasher.of(data)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for n, text, place, token in self.tokens.matches(h, counts, self.window):
            for t, p, k in zip(text.tolist(), place.tolist(), token.tolist()):
                hits.setdefault(t, []).append((p, n, k))
        out = [Found(c, [], [], {}) for c in counts.tolist()]
        for t, found in hits.items():
            out[t] = self._verify(data[t].translate(common.WORD_TABLE).split(), found)
        return out

    def _verify(self, words: list[bytes], found: list[tuple[int, int, int]]) -> Found:
        spans: set[tuple[int, int]] = set()
        by_item: dict[int, list[tuple[int, int]]] = {}
        for p, n, k in found:
            own = b" ".join(words[p : p + n])
            for e in self.entry[self.of[k] : self.of[k + 1]].tolist():
                if self.blob[self.first[e] : self.last[e]] == own:
                    spans.add((p, p + n))
                    by_item.setdefault(int(self.whose[e]), []).append((p, e))
        contained = {}
        for item, places in by_item.items():
            share = self._containment(item, places, len(words))
            if share:
                contained[self.names[item]] = max(share, contained.get(self.names[item], 0.0))
        return Found(len(words), _union([list(x) for x in spans]), sorted({self.names[i] for i in by_item}), contained)

    def _containment(self, item: int, places: list[tuple[int, int]], n_words: int) -> float:
        """The largest share of the item's shingles in a window of the item's number of words, 0 below the threshold."""
        size, need = int(self.size[item]), int(self.need[item])
        width = int(self.words[item]) - min(self.window, int(self.words[item])) + 1  # shingles in an item-sized window
        if len(places) < need or n_words - min(self.window, int(self.words[item])) + 1 < need:  # length bound
            return 0.0
        places.sort()
        inside: dict[int, int] = {}
        best = prefix = low = 0
        for p, e in places:  # windows that end with a shared shingle
            inside[e] = inside.get(e, 0) + 1
            prefix += bool(self.prefix[e])
            while places[low][0] < p - width + 1:
                old = places[low][1]
                prefix -= bool(self.prefix[old])
                inside[old] -= 1
                if not inside[old]:
                    del inside[old]
                low += 1
            if prefix and len(inside) > best:  # positional bound: without one of the prefix too few remain
                best = len(inside)
        return best / size if best >= need else 0.0


def frequencies(docs: DataFrame, tokens: Tokens, window: int) -> np.ndarray:
    """Occurrences of the items' shingles over all documents; as many rows reach the driver as the block has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = common.WordHasher(), shared.value
        n = np.zeros(len(known.codes), np.int64)
        for batch in batches:
            data = _bytes(batch.column(0))
            for i, j in common.chunks_of(data):
                for *_, token in known.matches(*hasher.of(data[i:j]), window):
                    np.add.at(n, token, 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["token", "n"])

    sums = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(tokens.codes), np.int64)
    out[sums["token"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks_of(docs: DataFrame, benchmark: DataFrame, window: int, threshold: float, limit_bytes: int) -> Iterator[tuple]:
    """Broadcast indexes of blocks of about ``limit_bytes`` of item text each, and whether it is the last."""
    rows = _items(benchmark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // limit_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    for b in range(blocks):
        own = [(r["item"], r["text"]) for r in rows.where(F.col("block") == b).select("item", "text").collect()]
        index = Index(own, lambda tokens: frequencies(docs, tokens, window), window, threshold)
        yield docs.sparkSession.sparkContext.broadcast(index), b == blocks - 1


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()


def spans(
    docs: DataFrame, benchmark: DataFrame, finish: Callable, schema, window: int = 8, threshold: float = 0.8, limit_bytes: int = 32 << 20
) -> DataFrame:
    """The documents searched: ``finish(batch, found)`` makes a batch of ``schema`` from one of the documents and a Found for each row.

    A benchmark of any size is searched, in blocks of about ``limit_bytes`` of
    its text; the table is written after each block but the last, so that a
    task holds one index at a time.
    """
    name = f"found_{uuid.uuid4().hex}"

    def over(index, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = common.WordHasher()
            for batch in batches:
                data = _bytes(batch.column(batch.schema.names.index("text")))
                found = [f for i, j in common.chunks_of(data) for f in index.value.search(data[i:j], hasher)]
                found = [f.join(p) for f, p in zip(found, batch.column(batch.num_columns - 1).to_pylist())]
                own = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
                if last:
                    yield finish(own, found)
                else:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([f.packed() for f in found], pa.string())], batch.schema.names)

        return run

    common.small_batches(docs.sparkSession)
    out = docs.withColumn(name, F.lit(None).cast("string"))
    for index, last in blocks_of(docs, benchmark, window, threshold, limit_bytes):
        out = out.mapInArrow(over(index, last), schema if last else out.schema)
        out = out if last else common.materialize(out, "searched")
    return out


def match(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, threshold: float = 0.8, limit_bytes: int = 32 << 20
) -> DataFrame:
    """Benchmark items in documents, by a join of shingle sets.

    A shingle is ``window`` consecutive words; an item of fewer words, but not
    none, is one shingle. Tokens of the join are shingles, rarest in the
    documents first. Any shared shingle counts for n_hit (document words in an
    occurrence) and n_items, that is, a required overlap of one, of which the
    necessary prefix is the whole item. An item is contained if a window of
    the document of as many words as the item has holds ``threshold`` of its
    distinct shingles; there the prefix is the s - ceil(t s) + 1 rarest, and
    windows without one of these, or documents with too few shingles, are not
    counted out. Hashes find candidates; words decide.

    Returns a row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated (n_items >= min_items), items, spans (hit word ranges),
    contained (items), best_item and best_containment (of the contained ones;
    null and 0 without any; ties: the first as a string). Repeated item rows
    count once; items with null ids are left out; rows of one id with unlike
    texts are each an item of that name. Null text has no words; null and
    repeated doc_ids get a row each; with an empty benchmark nothing is hit;
    texts of any length are searched whole; other columns, of any name, are
    ignored. The index is broadcast; above ``limit_bytes`` of item text it is
    made, and the documents passed, in blocks.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.string(), pa.float64())
    names = [c.split()[0] for c in RESULT.split(", ")]

    def finish(batch: pa.RecordBatch, found: list[Found]) -> pa.RecordBatch:
        rows = []
        for doc_id, f in zip(batch.column(0).to_pylist(), found):
            sha = hashlib.sha256(",".join(f.items).encode()).hexdigest()
            best = min(f.contained, key=lambda i: (-f.contained[i], i), default=None)
            hit = sum(b - a for a, b in f.spans)
            rows.append((doc_id, f.words, hit, len(f.items), sha, len(f.items) >= min_items, f.items, f.spans, sorted(f.contained), best, f.contained.get(best, 0.0)))
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return spans(rows, benchmark, finish, RESULT, window, threshold, limit_bytes)


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Byte starts and ends of a text's words, and its bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.concatenate([[False], np.frombuffer(raw.translate(common.WORD_TABLE), np.uint8) != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2], raw


def cut_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the words of the spans."""
    if not text or not spans:
        return text
    starts, ends, raw = word_bounds(text)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
