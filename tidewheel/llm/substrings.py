"""Removal of long byte strings that occur more than once in a corpus, by suffix arrays over shared anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffixes import repeated_windows

#: Bytes an anchor hash covers. A window of T bytes holds T - CORE + 1 of them.
CORE = 80
#: Bytes of text whose anchors are sought at a time; longer texts are cut into overlapping parts.
PART = 1 << 20
#: Distinct pieces of one anchor that a task holds and sorts; larger groups are resolved by hashes of their windows.
GROUP = 2000


class Anchors:
    """For each window of ``size`` bytes, its anchor: the core with the least hash in it, the last of equal ones.

    Windows with one content have one anchor at one offset, so equal windows
    always meet under their anchor's hash, wherever they stand.
    """

    def __init__(self, size: int, seed: int = 23) -> None:
        self.size, self.core = size, min(CORE, max(1, size // 2))
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.mul = rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        """Hashes of all cores, from those of power-of-two lengths."""
        h, span, level, out, done = self.table[raw], 1, 0, None, 0
        while True:
            if self.core & span:
                if out is None:
                    out = h
                else:
                    part = h[done:]
                    n = min(len(out), len(part))
                    out = out[:n] * self.mul[32 + level] + part[:n]
                    out ^= out >> np.uint64(31)
                done += span
            if done == self.core:
                return out
            h = h[:-span] * self.mul[level] + h[span:]
            h ^= h >> np.uint64(29)
            span, level = span * 2, level + 1

    def of(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, anchor place, first window, last window) of each run of windows with one anchor, texts of ``size`` or more only."""
        lengths = np.array([len(x) for x in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        h = self.hashes(raw)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
        width, span = self.size - self.core + 1, 1
        low = key
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        place = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
        text = np.searchsorted(ends, np.arange(len(place)), side="right")
        valid = np.arange(len(place)) + self.size <= ends[text]
        turn = np.ones(len(place), bool)
        turn[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(turn)
        last = np.append(first[1:], len(place)) - 1
        keep = valid[first]
        first, last = first[keep], last[keep]
        text = text[first]
        base = starts[text]
        return text, h[place[first]].view(np.int64), place[first] - base, first - base, last - base


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def resolve(pieces: list[tuple[bytes, int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Covered byte ranges of pieces (bytes, anchor offset, copies) that share an anchor.

    Pieces with copies are covered whole. What a piece can share with any
    other through the anchor reaches no further than it shares with its
    neighbours, in the order of what follows the anchor and of what precedes
    it; pieces for which that is below ``size`` are settled. The others, cut
    to that reach, go through a suffix array together.
    """
    out: list[list[tuple[int, int]]] = [[(0, len(p))] if c > 1 else [] for p, _, c in pieces]
    if len(pieces) < 2:
        return out
    reach = []
    for side in (lambda p, a: p[a:], lambda p, a: p[:a][::-1]):
        keys = [side(p, a) for p, a, _ in pieces]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        most = [0] * len(keys)
        for x, y in zip(order, order[1:]):
            n = common_prefix(keys[x], keys[y])
            most[x] = max(most[x], n)
            most[y] = max(most[y], n)
        reach.append(most)
    open_ = [k for k in range(len(pieces)) if reach[0][k] + reach[1][k] >= size]
    if all(pieces[k][2] > 1 for k in open_):
        return out
    cut: dict[bytes, list[tuple[int, int]]] = {}
    for k in open_:
        p, a, _ = pieces[k]
        cut.setdefault(p[a - reach[1][k] : a + reach[0][k]], []).append((k, a - reach[1][k]))
    alone = []
    for s, who in cut.items():
        if len(who) > 1:
            for k, at in who:
                out[k].append((at, at + len(s)))
        elif pieces[who[0][0]][2] == 1:
            alone.append(s)
    if alone:
        strings = list(cut)
        for s, starts in zip(strings, repeated_windows(strings, size)):
            for k, at in cut[s]:
                out[k].extend((at + x, at + x + size) for x in starts)
    return out


def union(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def parts_of(data: list[bytes], size: int, limit: int = PART) -> Iterator[tuple[int, int, bytes]]:
    """(text, offset, bytes) of texts, long ones in parts that overlap by size - 1 bytes: each window is in one part."""
    for k, x in enumerate(data):
        if len(x) <= limit + size - 1:
            yield k, 0, x
        else:
            for at in range(0, len(x) - size + 1, limit):
                yield k, at, x[at : at + limit + size - 1]


class Group:
    """Pieces that share an anchor, as they come; what they cover goes to ``spans``, window hashes to ``windows``.

    A piece that comes twice is covered whole and needs no owner any more.
    Beyond ``limit`` distinct pieces the group is not held: from there on each
    of its pieces gives the hashes of all its windows, to be counted
    elsewhere.
    """

    def __init__(self, size: int, limit: int, spans: list[tuple], windows: list[tuple]) -> None:
        self.size, self.limit, self.spans, self.windows = size, limit, spans, windows
        self.held: dict[tuple[bytes, int], list] = {}
        self.over = False

    def hash(self, piece: bytes, owner: dict | None) -> None:
        key, start = (owner["k"], owner["s"]) if owner else (None, 0)
        for i in range(len(piece) - self.size + 1):
            w = hashlib.md5(piece[i : i + self.size]).digest()
            self.windows.append((key, start + i, start + i + self.size, w))

    def add(self, piece: bytes, back: int, who: list[dict], hot: bool = False) -> None:
        if hot or self.over:
            if len(who) > 1:  # its own windows are twice there; they still count for others
                self.spans.extend((m["k"], m["s"], m["s"] + len(piece)) for m in who)
                self.hash(piece, None)
            else:
                self.hash(piece, who[0])
            return
        entry = self.held.get((piece, back))
        if entry is None:
            entry = self.held[piece, back] = [0, who[0]]
        else:
            who = [entry[1], *who] if entry[1] else who
        entry[0] += len(who) - (1 if entry[0] and entry[1] else 0)
        if entry[0] > 1:
            self.spans.extend((m["k"], m["s"], m["s"] + len(piece)) for m in who)
            entry[1] = None
        if len(self.held) > self.limit:
            for (p, _), (_, owner) in self.held.items():
                self.hash(p, owner)
            self.held, self.over = {}, True

    def close(self) -> None:
        info = [(p, back, n) for (p, back), (n, _) in self.held.items()]
        for covered, (_, owner) in zip(resolve(info, self.size), self.held.values()):
            if owner:
                self.spans.extend((owner["k"], owner["s"] + a, owner["s"] + b) for a, b in union(covered))
        self.held, self.over = {}, False


class Repeats:
    """Distinct long texts and what of them stands anywhere else: ``texts`` (text_key, raw, uses, row) and ``spans`` (text_key, spans).

    A text that occurs twice as a whole is covered whole, without spans.
    Texts are written once, in buckets of their key, so that they aren't
    shuffled again. Their anchors are written and sorted by hash once; those
    that occur once end there. Around the others the windows' bytes are sent,
    equal ones of a batch merged, and each anchor's group is resolved exactly.

    No anchor makes a large task. An anchor that is in a part of a batch twice
    is shared for certain: one of its places goes to the anchor's own task,
    the others to any. Groups with over ``group`` pieces, and of these at most
    100,000 by a broadcast of their hashes, are spread over tasks and resolved
    by counting the hashes (128 bits) of all their windows.
    """

    def __init__(self, docs: DataFrame, size: int, group: int, row: bool) -> None:
        spark, self.size, self.group = docs.sparkSession, size, group
        common.small_batches(spark)
        long_ = docs.where(F.octet_length("text") >= size)
        cols = F.struct(*docs.columns[:]) if row else F.lit(None).cast("int")
        raw = F.col("text").cast("binary")
        long_ = long_.select(F.unhex(F.md5(raw)).alias("text_key"), raw.alias("raw"), cols.alias("row"))
        if row:
            long_ = long_.withColumn("row", F.col("row").dropFields("text"))
        distinct = long_.groupBy("text_key").agg(F.first("raw").alias("raw"), F.count("*").alias("uses"), F.first("row").alias("row"))
        self.table = common.Bucketed(distinct, "texts", "text_key")
        self.texts = self.table.df
        self.spans = self._covered(self._shared()).groupBy("text_key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def _shared(self) -> DataFrame:
        """Anchors that stand in two places or more: text_key, h, at."""
        size = self.size

        def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Anchors(size)
            for b in batches:
                keys = b.column(0)
                parts = list(parts_of(b.column(1).to_pylist(), size))
                for i, j in common.chunks_of(parts, lambda x: len(x[2]), PART):
                    own, at = (np.array([x[c] for x in parts[i:j]], np.int64) for c in (0, 1))
                    whose, h, place, first, last = finder.of([x[2] for x in parts[i:j]])
                    packed = ((place + at[whose]) << 32) | ((place - first) << 16) | (last - first)
                    order = np.argsort(h, kind="stable")
                    lead = np.ones(len(h), bool)
                    lead[1:] = h[order][1:] != h[order][:-1]
                    follows = np.append(~lead[1:], False)[: len(h)]
                    kind = np.empty(len(h), np.int8)
                    kind[order] = np.where(lead, np.where(follows, 1, 0), 2)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(own[whose])), pa.array(h), pa.array(packed), pa.array(kind)], ["text_key", "h", "at", "kind"]
                    )

        def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, known = None, False  # the last row of a batch waits for the next one
            for b in batches:
                kind = b.column(3).to_numpy(zero_copy_only=False)
                passed = b.filter(pa.array(kind == 2))
                if passed.num_rows:
                    yield passed.select([0, 1, 2])
                rest = b.filter(pa.array(kind != 2))
                if not rest.num_rows:
                    continue
                if last is not None:
                    rest = pa.Table.from_batches([last, rest]).combine_chunks().to_batches()[0]
                h, multi = rest.column(1).to_numpy(), rest.column(3).to_numpy() == 1
                same = h[1:] == h[:-1]
                keep = multi.copy()
                keep[1:] |= same
                keep[:-1] |= same
                keep[0] |= known
                last, known = rest.slice(len(h) - 1), bool(keep[-1])
                yield rest.slice(0, len(h) - 1).filter(pa.array(keep[:-1])).select([0, 1, 2])
            if last is not None and known:
                yield last.select([0, 1, 2])

        found = self.texts.select("text_key", "raw").mapInArrow(anchors, "text_key binary, h long, at long, kind byte")
        to = F.when(F.col("kind") == 2, F.xxhash64("text_key", "at")).otherwise(F.col("h"))
        out = found.repartition(to).sortWithinPartitions("h").mapInArrow(shared, "text_key binary, h long, at long")
        return common.materialize(out, "shared")

    def _covered(self, shared: DataFrame) -> DataFrame:
        size, group = self.size, self.group
        least = max(group, shared.count() // 100_000)
        hot = shared.groupBy("h").count().where(F.col("count") > least).select("h", F.lit(True).alias("hot"))
        shared = shared.join(F.broadcast(hot), "h", "left")  # 100,000 rows at most
        by_text = shared.groupBy("text_key").agg(F.collect_list(F.struct("h", "at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("anchors"))

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                merged: dict[tuple, list] = {}
                for key, raw, ats in zip(*(c.to_pylist() for c in b.columns)):
                    for x in ats:
                        at = x["at"]
                        place, back, run = at >> 32, (at >> 16) & 65535, at & 65535
                        first = place - back
                        merged.setdefault((x["h"], raw[first : first + run + size], back, x["hot"]), []).append({"k": key, "s": first})
                cols = list(zip(*merged)) if merged else [[]] * 4
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.list_(pa.struct([("k", pa.binary()), ("s", pa.int64())])))
                made = [pa.array(c, k) for c, k in zip([*cols, list(merged.values())], kinds)]
                yield pa.RecordBatch.from_arrays(made, ["h", "piece", "back", "hot", "who"])

        def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spans: list[tuple] = []
            windows: list[tuple] = []
            current, own = None, Group(size, group, spans, windows)

            def batch_of() -> pa.RecordBatch:
                rows = [(*x, None) for x in spans] + windows
                spans.clear()
                windows.clear()
                cols = list(zip(*rows)) if rows else [[]] * 4
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["text_key", "a", "b", "w"])

            for b in batches:
                for h, piece, back, hot, who in zip(*(c.to_pylist() for c in b.columns)):
                    if h != current and not hot:
                        own.close()
                        current = h
                    own.add(piece, back, who, hot)
                    if len(windows) > 50_000:
                        yield batch_of()
                yield batch_of()
            own.close()
            yield batch_of()

        sent = self.texts.join(by_text, "text_key").select("text_key", "raw", "anchors")
        sent = sent.mapInArrow(pieces, "h long, piece binary, back int, hot boolean, who array<struct<k:binary,s:long>>")
        to = F.when(F.col("hot"), F.xxhash64("piece")).otherwise(F.col("h"))
        sent = sent.repartition(to).sortWithinPartitions("h")
        found = common.materialize(sent.mapInArrow(groups, "text_key binary, a long, b long, w binary"), "covered")
        sure = found.where("w is null").select("text_key", "a", "b")
        open_ = found.where("w is not null")
        if not open_.limit(1).count():
            return sure
        twice = open_.groupBy("w").agg(F.count("*").alias("uses")).where("uses > 1")
        more = common.lookup(open_, twice, "w", "uses").where("uses is not null and text_key is not null")
        return sure.unionByName(more.select("text_key", "a", "b"))

    def joined(self) -> DataFrame:
        return self.texts.join(self.spans, "text_key", "left")


def strip(raw: bytes, whole: bool, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of removed runs."""
    runs = [[0, len(raw)]] if whole else union([(x["a"], x["b"]) for x in spans or []])
    parts, at = [], 0
    for s, e in runs:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]]), len(runs)


def remove_repeats(docs: DataFrame, size: int = 200, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Every byte in a ``size``-byte string that also starts anywhere else, in
    the same text (overlaps count) or another, is removed; strings are judged
    on the input. Null text is empty; null and repeated doc_ids get a row
    each; equal rows repeat each other, so both lose all their bytes where
    long enough. Texts of any length are searched whole. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = Repeats(docs, size, group, row=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, raw, uses, spans in zip(*(c.to_pylist() for c in b.columns)):
                left, n = strip(raw, uses > 1, spans)
                if n:
                    rows.append((key, uses, len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["text_key", "uses", "n_removed", "n_spans", "kept_sha256"])

    hit = found.joined().where("uses > 1 or spans is not null").select("text_key", "raw", "uses", "spans")
    hit = common.materialize(hit.mapInArrow(run, "text_key binary, uses long, n_removed long, n_spans long, kept_sha256 string"), "repeats")
    found.table.drop()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.unhex(F.md5(text.cast("binary"))).alias("text_key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("whole"),
    )
    zero = F.lit(0).cast("long")
    return common.lookup(rows, hit, "text_key", "uses").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, size: int = 200, group: int = GROUP) -> DataFrame:
    """The documents, all columns, with their texts stripped like :func:`remove_repeats`; characters cut in part go.

    Texts that occur twice as a whole, and have ``size`` bytes or more, lose
    all; these rows aren't returned. All others are, one row each, with a null
    text as it came. Columns of any name stay.
    """
    found = Repeats(docs, size, group, row=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [strip(raw, False, spans)[0].decode("utf-8", "ignore") for raw, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), b.column(2)], ["text", "row"])

    once = found.joined().where("uses = 1").select("raw", "spans", "row")
    kind = once.schema["row"].dataType.simpleString()
    stripped = once.mapInArrow(run, f"text string, row {kind}")
    names = [c for c in docs.columns if c != "text"]
    stripped = stripped.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
    short = docs.where(F.col("text").isNull() | (F.octet_length("text") < size))
    return short.unionByName(stripped.select(*names, "text").select(*docs.columns))
