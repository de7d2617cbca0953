"""Language identification by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import default_paths

MARK = b" "  # begins every word, as in the vocabulary


class Pieces:
    """A fixed public vocabulary of byte strings, found by a rolling hash; all 256 bytes are in it, so every word has a segmentation."""

    def __init__(self, ranks_path: str, longest: int | None = None) -> None:
        """All pieces of the vocabulary that can stand in a marked word; ``longest`` bounds them only in tests."""
        with open(ranks_path, "rb") as f:
            known = {base64.b64decode(line.split()[0]) for line in f}
        usable = lambda p: p.translate(common.WORD_TABLE) == p and MARK not in p[1:] and (longest is None or len(p) <= longest)
        fits = sorted({p for p in known if usable(p)} | {bytes([b]) for b in range(256)})
        self.longest, self.sizes = max(map(len, fits)), frozenset(map(len, fits))
        rng = np.random.default_rng(3)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        code = []
        for p in fits:
            h = 0
            for b in p:
                h = (h * int(self.base) + int(self.table[b])) & (2**64 - 1)
            code.append(h)
        code = np.array(code, np.uint64)
        order = np.argsort(code)
        self.codes, self.size = code[order], len(fits)
        self.lengths = np.array([len(p) for p in fits])[order]
        # A table of 2 ** 20 places answers most look-ups with one read.
        self.bits = np.uint64(44)
        self.slot = np.searchsorted(self.codes, np.arange(1 << 20, dtype=np.uint64) << self.bits).astype(np.int32)
        edges = np.append(self.slot, len(self.codes))
        self.deepest = int(np.diff(edges).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each code, or -1."""
        at = self.slot[(h >> self.bits).astype(np.int64)].astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        for k in range(self.deepest):
            i = np.minimum(at + k, len(self.codes) - 1)
            out = np.where(self.codes[i] == h, i, out)
        return out

    def lattice(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, int, list]]:
        """Words of one length together: their numbers, the length, and by each end the pieces: (start, places of the words that have one, piece numbers)."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, ks in by.items():
            for a in range(0, len(ks), 1 << 15):
                part = ks[a : a + (1 << 15)]
                raw = np.frombuffer(b"".join(words[k] for k in part), np.uint8).reshape(len(part), n)
                value = self.table[raw]
                found: list[list[tuple]] = [[] for _ in range(n + 1)]
                for start in range(n):
                    h = np.zeros(len(part), np.uint64)
                    for size in range(1, min(self.longest, n - start) + 1):
                        h = h * self.base + value[:, start + size - 1]
                        if size in self.sizes:
                            piece = self.find(h)
                            at = np.flatnonzero(piece >= 0)
                            if len(at):
                                found[start + size].append((start, at, piece[at]))
                yield np.array(part), n, found


#: Words above this length are summed place by place instead of all words of a length together.
LONG = 64


class Chain:
    """One long word, place by place: memory for forward sums in windows of the longest piece, and scaled so that nothing underflows."""

    def __init__(self, pieces: Pieces, p: np.ndarray, word: bytes, part: int = 1 << 14) -> None:
        self.pieces, self.p, self.word, self.part = pieces, p, word, part

    def ending(self, lo: int, hi: int) -> np.ndarray:
        """Piece numbers by place (lo <= end - 1 < hi) and length - 1; -1 where there is none."""
        k, n = self.pieces.longest, hi - lo
        raw = np.frombuffer(self.word[max(0, lo - k + 1) : hi], np.uint8)
        before = lo - max(0, lo - k + 1)
        value, h = self.pieces.table[raw], np.zeros(len(raw), np.uint64)
        out = np.full((n, k), -1, np.int64)
        for size in range(1, min(k, len(raw)) + 1):
            h = h[: len(raw) - size + 1] * self.pieces.base + value[size - 1 :]
            if size not in self.pieces.sizes:
                continue
            ends = np.arange(size - 1, len(raw)) - before  # of each start, relative to lo
            inside = ends >= 0
            out[ends[inside], size - 1] = self.pieces.find(h[inside])
        return out

    def forward(self, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Log of the sum over all segmentations, by language; with ``keep`` also all scaled sums and the scales' logs."""
        k, n, langs = self.pieces.longest, len(self.word), self.p.shape[1]
        ring = np.zeros((k, langs))  # sums at the k places before, latest first
        ring[0] = 1.0
        scale = np.zeros(langs)
        alpha = np.zeros((n + 1, langs)) if keep else None
        scales = np.zeros((n + 1, langs)) if keep else None
        if keep:
            alpha[0] = 1.0
        for lo in range(0, n, self.part):
            found = self.ending(lo, min(n, lo + self.part))
            for i in range(len(found)):
                new = (ring * self.p[found[i]]).sum(0)
                top = np.maximum(new, 1e-300)
                ring[1:] = ring[:-1] / top
                ring[0] = new / top
                scale = scale + np.log(top)
                if keep:
                    alpha[lo + i + 1], scales[lo + i + 1] = ring[0], scale
        return scale, alpha, scales

    def expected(self, weight: np.ndarray, out: np.ndarray) -> None:
        """Add the expected counts of each piece, times ``weight`` by language."""
        k, n = self.pieces.longest, len(self.word)
        total, alpha, scales = self.forward(keep=True)
        found = self.ending(0, n)
        beta, tail = np.zeros((n + 1, self.p.shape[1])), np.zeros((n + 1, self.p.shape[1]))
        beta[n] = 1.0
        for start in range(n - 1, -1, -1):
            ends = np.arange(start + 1, min(n, start + k) + 1)
            piece = found[ends - 1, ends - start - 1]
            near = tail[start + 1]
            new = (beta[ends] * np.exp(tail[ends] - near) * self.p[piece]).sum(0)
            top = np.maximum(new, 1e-300)
            beta[start], tail[start] = new / top, near + np.log(top)
        for size in range(1, min(k, n) + 1):
            ends = np.arange(size, n + 1)
            piece = found[ends - 1, size - 1]
            hit = piece >= 0
            ends, piece = ends[hit], piece[hit]
            share = alpha[ends - size] * beta[ends] * np.exp(scales[ends - size] + tail[ends] - total)
            np.add.at(out, piece, share * self.p[piece] * weight)


def forward(pieces: Pieces, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log-probability of each word in each language: the sum over all its segmentations (rows of logp: pieces, then a row of -inf)."""
    out = np.zeros((len(words), logp.shape[1]))
    p = np.exp(logp)
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    for part, n, found in pieces.lattice([words[k] for k in short]):
        alpha = np.zeros((n + 1, len(part), logp.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros((len(part), logp.shape[1]))
        for end in range(1, n + 1):
            for start, at, piece in found[end]:
                alpha[end][at] += alpha[start][at] * p[piece]
            if end % 16 == 0:  # keep words in range
                top = alpha[max(0, end - pieces.longest + 1) : end + 1].max(0)
                top[top <= 0] = 1.0
                alpha[max(0, end - pieces.longest + 1) : end + 1] /= top
                scale += np.log(top)
        with np.errstate(divide="ignore"):
            out[np.array(short)[part]] = np.log(alpha[n]) + scale
    for k, w in enumerate(words):
        if len(w) > LONG:
            out[k] = Chain(pieces, p, w).forward()[0]
    return out


def fit(counts: dict[bytes, np.ndarray], pieces: Pieces, languages: int, rounds: int = 4) -> np.ndarray:
    """Log piece probabilities (pieces + 1 by languages) by expectation-maximisation over all segmentations of all words."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], float).reshape(len(words), languages)
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    lattice = [(np.array(short)[part], n, found) for part, n, found in pieces.lattice([words[k] for k in short])]
    p = np.zeros((pieces.size + 1, languages))
    p[:-1] = (1.0 / 256.0 ** pieces.lengths.clip(max=3))[:, None]
    p[:-1] /= p[:-1].sum(0)
    for _ in range(rounds):
        expected = np.zeros_like(p)
        for part, n, found in lattice:
            alpha = np.zeros((n + 1, len(part), languages))
            beta = np.zeros_like(alpha)
            alpha[0] = beta[n] = 1.0
            for end in range(1, n + 1):
                for start, at, piece in found[end]:
                    alpha[end][at] += alpha[start][at] * p[piece]
            for end in range(n, 0, -1):
                for start, at, piece in found[end]:
                    beta[start][at] += p[piece] * beta[end][at]
            share = weight[part] / np.maximum(alpha[n], 1e-300)
            for end in range(1, n + 1):
                for start, at, piece in found[end]:
                    np.add.at(expected, piece, alpha[start][at] * beta[end][at] * share[at] * p[piece])
        for k, w in enumerate(words):
            if len(w) > LONG:
                Chain(pieces, p, w).expected(weight[k], expected)
        p[:-1] = expected[:-1] + 0.01
        p[:-1] /= p[:-1].sum(0)
    with np.errstate(divide="ignore"):
        return np.log(p)


class Model:
    def __init__(self, languages: list[str], logp: np.ndarray, prior: np.ndarray, ranks: str) -> None:
        self.languages, self.logp, self.prior, self.ranks = languages, logp, prior, ranks


class Scorer:
    """Scores whole texts, with a bounded cache of words."""

    def __init__(self, model: Model, limit: int = 300_000) -> None:
        self.m, self.limit = model, limit
        self.pieces = Pieces(model.ranks)
        self.cache: dict[bytes, int] = {}
        self.table = np.zeros((limit, len(model.languages)))

    def totals(self, texts: list[str | None]) -> np.ndarray:
        out = np.tile(self.m.prior, (len(texts), 1))
        lists = [common.words(t) for t in texts]
        new = set().union(*lists) - self.cache.keys() if lists else set()
        if len(self.cache) + len(new) > self.limit:
            self.cache = {}
            new = set().union(*lists)
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), len(self.m.languages)))
        if new:
            new = sorted(new)
            n = len(self.cache)
            self.table[n : n + len(new)] = forward(self.pieces, self.m.logp, [MARK + w for w in new])
            self.cache.update(zip(new, range(n, n + len(new))))
        get = self.cache.__getitem__
        for k, ws in enumerate(lists):
            if ws:
                out[k] += self.table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total = self.totals(texts)
        if not len(total):
            return [], np.zeros(0)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        none = np.array([not t or common.LETTER.search(t) is None for t in texts])
        return [("und" if x else self.m.languages[b]) for x, b in zip(none, best)], np.where(none, 0.0, share)


def learn(docs: DataFrame, ranks: str | None = None, sample_rows: int = 6000) -> Model | None:
    """Fit on about ``sample_rows`` training rows (a fixed bound, drawn by a hash of the id) with a language and text.

    All words of these rows count. None if no row has a language. Ties of
    languages go to the first name; priors count all training rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    ranks = ranks or default_paths()[1]
    rows = docs.where(common.in_training()).where("lang is not null and text is not null").select("doc_id", "lang", "text")
    per = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not per:
        return None
    languages = sorted(per)
    each = sample_rows / len(languages)
    rate = F.create_map(*[F.lit(x) for k, n in per.items() for x in (k, int(1_000_000 * min(1.0, each / n)))])
    few = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in common.words(text):
                    n[lang, w] = n.get((lang, w), 0) + 1
        cols = ([k[0] for k in n], [k[1] for k in n], list(n.values()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int64()))], ["lang", "word", "n"])

    sums = few.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    number = {x: k for k, x in enumerate(languages)}
    counts: dict[bytes, np.ndarray] = {}
    for lang, word, n in zip(*sums.toArrow().to_pydict().values()):  # words of the sample
        counts.setdefault(MARK + word, np.zeros(len(languages)))[number[lang]] = n
    logp = fit(counts, Pieces(ranks), len(languages))
    prior = np.log(np.array([per[x] for x in languages], float) / sum(per.values()))
    return Model(languages, logp, prior, ranks)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Null texts and texts without a letter are ``und`` with score 0; so is all
    without a model. Null or repeated doc_ids get a row each; other columns,
    of any name, are ignored; an empty table gives no rows. The score is the
    posterior share of the predicted language; ties go to the first name.
    Texts of any length count whole; a word of over 64 bytes is summed place
    by place, in time and memory proportional to its length.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # pieces x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            pred, share = scorer.predict(texts) if scorer else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(share, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", common.held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
