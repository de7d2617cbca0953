"""Quality scores: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Classes of bytes for the shape n-grams: letters by case, digits; other bytes stay themselves.
SHAPE = np.array([97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint64)


class Features:
    """Distinct hashed n-gram indicators of a text: words, word pairs, byte-class 6-grams and repeat-flag 6-grams."""

    def __init__(self, bits: int = 17) -> None:
        self.size, self.mask = 1 << bits, np.uint64((1 << bits) - 1)
        self.hasher = common.WordHasher(seed=11)
        self.stamp = np.zeros(self.size, np.int64)

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        for i, j in common.chunks_of(data):
            h, counts = self.hasher.of(data[i:j])
            pair = common.mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
            same = np.zeros(len(h), np.uint64)
            same[1:] = h[1:] == h[:-1]
            at = 0
            for raw, n in zip(data[i:j], counts.tolist()):
                flags = same[at : at + n].copy()
                flags[:1] = 0
                shape = SHAPE[np.frombuffer(raw, np.uint8)]
                parts = [h[at : at + n], pair[at : at + max(0, n - 1)], self._grams(shape, 6, 3), self._grams(flags, 6, 5)]
                f = (np.concatenate(parts) & self.mask).astype(np.int64)
                where = np.arange(len(f))
                self.stamp[f] = where  # the last of equal ones stays
                out.append(f[self.stamp[f] == where])
                at += n
        return out

    @staticmethod
    def _grams(x: np.ndarray, n: int, seed: int) -> np.ndarray:
        if len(x) < n:
            return np.zeros(0, np.uint64)
        h = np.full(len(x) - n + 1, seed, np.uint64)
        for k in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + x[k : len(x) - n + 1 + k]
        return common.mix64(h)


def log_count_ratio(n1: np.ndarray, n0: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each indicator in class 1 against class 0."""
    p, q = n1 + smooth, n0 + smooth
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 1):
    """Weights and bias of an L2-regularised hinge loss by dual coordinate descent; rows are unit vectors of scaled indicators."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(ratio)), 0.0
    values = []
    for f in rows:
        v = ratio[f]
        values.append(v / max(np.sqrt((v * v).sum()), 1e-12))
    alpha = np.zeros(len(rows))
    upper = cost * np.where(y > 0, 1.0, max(1.0, (y > 0).sum() / max(1, (y < 0).sum())))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            g = y[i] * (w[f] @ v + bias) - 1
            a = min(max(alpha[i] - g / ((v @ v) + 1.0), 0.0), upper[i])
            if step := a - alpha[i]:
                w[f] += step * y[i] * v
                bias += step * y[i]
                alpha[i] = a
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, ab = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (p - t)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab = ab - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


class Model:
    """Scores of texts between 0 and 1."""

    def __init__(self, bits: int, ratio: np.ndarray, w: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.bits, self.gain, self.square = bits, (w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32)
        self.bias, self.slope, self.offset = bias, slope, offset

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        m = np.array([self.gain[f].sum(dtype=np.float64) / max(np.sqrt(self.square[f].sum(dtype=np.float64)), 1e-12) + self.bias for f in features])
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))) if len(m) else m


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = 17, sample_rows: int = 8000, cost: float = 1.0, epochs: int = 20
) -> Model | None:
    """Learn from training rows (see ``common.in_training``) whose label isn't null.

    The log-count ratios count all of them; the linear model is fitted on the
    driver to a sample of about ``sample_rows`` by a hash of the id, a fixed
    bound. None if there are no labelled rows of both classes. Label rows of
    one id count once; where they clash the id teaches nothing. Rows of
    documents with one id each take its label. Other columns, of any name, are
    ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    marks = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    marks = marks.where(common.in_training())
    total = marks.count()
    if total <= 2_000_000:  # 32 MB at most; beyond that the join shuffles
        marks = F.broadcast(marks)
    rows = docs.select("doc_id", "text").join(marks, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        n = np.zeros((2, features.size), np.int64)
        for batch in batches:
            for f, y in zip(features.of(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                n[int(y > 0)][f] += 1
        seen = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[1][seen]), pa.array(n[0][seen])], ["f", "n1", "n0"])

    counts = rows.select("text", "y").mapInArrow(count, "f int, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    got = counts.toPandas()  # 2 ** bits rows at most
    n1, n0 = np.zeros(1 << bits), np.zeros(1 << bits)
    n1[got["f"]], n0[got["f"]] = got["n1"], got["n0"]
    ratio = log_count_ratio(n1, n0)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            f = [x.astype("<i4").tobytes() for x in features.of(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), batch.column(1), batch.column(2)], ["f", "y", "k"])

    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    few = rows.where(rank < int(1_000_000 * min(1.0, sample_rows / max(1, total)))).select("text", "y", F.xxhash64("doc_id", "text").alias("k"))
    drawn = few.mapInArrow(sample, "f binary, y int, k long").toPandas().sort_values("k")
    y = np.where(drawn["y"].to_numpy() > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        return None
    x = [np.frombuffer(f, "<i4").astype(np.int64) for f in drawn["f"]]
    part = max(1, len(x) // 5)
    w, bias = dual_descent(x[part:], y[part:], ratio, cost, epochs)
    raw = Model(bits, ratio, w, bias, 1.0, 0.0)
    p = np.clip(raw.score(x[:part]), 1e-12, 1 - 1e-12)
    slope, offset = platt(np.log(p / (1 - p)), y[:part])
    return Model(bits, ratio, w, bias, max(slope, 1e-3), offset)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null text scores as empty; without a model every score is 0.5. Rows with
    null or repeated doc_ids get a score each; other columns are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # two arrays of 2 ** bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        features = Features(m.bits) if m else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            s = m.score(features.of(texts)) if m else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", common.held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
