"""Summaries of synthetic data: discriminative score, train on synthetic and test on real, and an embedding in the plane."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import WrongParameter
from ..frame import Series
from ..functions.windows import row_index
from .base import Operator
from .models import LinearRegression, SparkModel


def _usable(x: Series, mask: Series | None) -> DataFrame:
    df = x.frame("x").withColumn("x", F.col("x").cast("array<double>")).where(F.forall("x", lambda v: v.isNotNull()))
    return df if mask is None else df.join(mask.df.where(mask.col).select(*x.index), x.index, "left_semi")


def spread(spark, name: str, values: list[float]) -> DataFrame:
    stats = {"sum": sum(values), "min": min(values), "max": max(values), "mean": sum(values) / len(values)}
    return spark.createDataFrame([(name, k, float(v)) for k, v in stats.items()], "name string, key string, value double")


class DiscriminativeScore(Operator):
    """How far from 0.5 a classifier gets that tells real from synthetic arrays: 0 is best. Mask inputs end with ``_mask``."""

    def __init__(self, repetitions: int = 3, test_size: float = 0.3, hidden: int = 5, seed: int = 0, get_model=None, name: str = "DiscriminativeScore") -> None:
        """``get_model(width, k)`` gives the ``pyspark.ml`` classifier of the k-th repetition."""
        self.repetitions, self.test_size, self.hidden, self.seed, self.get_model, self.name = repetitions, test_size, hidden, seed, get_model, name

    def transform(self, gt: Series, **synthetic: Series) -> DataFrame:
        masks = {k.removesuffix("_mask"): synthetic.pop(k) for k in list(synthetic) if k.endswith("_mask")}
        real, out = _usable(gt, masks.get("gt")), None
        for name, s in synthetic.items():
            fake = _usable(s, masks.get(name))
            n = min(real.count(), fake.count())
            both = None
            for label, df, time in ((1.0, real, gt.time), (0.0, fake, s.time)):
                part = row_index(df, time, "_rn").where(F.col("_rn") < n).select("x", F.lit(label).alias("label"))
                both = part if both is None else both.unionByName(part)
            width = both.select(F.max(F.size("x"))).first()[0]
            m = both.agg(*[f(F.get("x", F.lit(i))) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
            scaled = F.array(*[(F.get("x", F.lit(i)) - m[2 * i]) / (m[2 * i + 1] or 1.0) for i in range(width)])
            data = both.select(array_to_vector(scaled).alias("features"), "label").persist()
            scores = []
            for k in range(self.repetitions):
                train, test = data.randomSplit([1 - self.test_size, self.test_size], self.seed + k)
                made = self.get_model(width, k) if self.get_model else MultilayerPerceptronClassifier(layers=[width, self.hidden, 2], seed=self.seed + k, maxIter=50)
                net = made.fit(train)
                scores.append(abs(net.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] - 0.5))
            data.unpersist()
            part = spread(gt.df.sparkSession, name, scores)
            out = part if out is None else out.unionByName(part)
        return out


class TrainSyntheticTestReal(Operator):
    """Errors on real data of models trained on synthetic data, and of those trained on real data.

    The last ``n_targets`` elements of each array are forecast from the
    others; rows up to ``train_test_split`` train, the later real ones test.
    ``task``: regression (rmse, mae, mape) or classification (accuracy, f1
    over classes alike; one target). ``get_model(k)`` gives the estimator of
    the k-th of ``repetitions`` fits. Of each metric: sum, min, max and mean
    over the repetitions. Mask inputs end with ``_mask``.
    """

    METRICS = {"regression": ("rmse", "mae", "mape"), "classification": ("accuracy", "f1")}

    def __init__(self, train_test_split: float = 0.66, metrics: list[str] | None = None, n_targets: int = 1, repetitions: int = 5, task: str = "regression", get_model=None, name: str = "TSTR") -> None:
        if task not in self.METRICS:
            raise WrongParameter(f"Task {task!r} is unknown.", f"Use one of {sorted(self.METRICS)}.")
        self.metrics = metrics or list(self.METRICS[task][:2])
        if bad := [m for m in self.metrics if m not in self.METRICS[task]]:
            raise WrongParameter(f"Metrics {bad} are unknown.", f"Use some of {self.METRICS[task]}.")
        if task == "classification" and n_targets != 1:
            raise WrongParameter("A classification has one target.", f"n_targets is {n_targets}.")
        self.train_test_split, self.n_targets, self.repetitions, self.task, self.get_model, self.name = train_test_split, n_targets, repetitions, task, get_model, name

    def _model(self, k: int):
        if self.get_model:
            return self.get_model(k)
        if self.task == "classification":
            return SparkModel(LogisticRegression())
        return LinearRegression()

    def _scores(self, p: Series, t: Series) -> dict[str, float]:
        both = p.frame("p").join(t.frame("t"), t.index)
        if p.is_array:
            both = both.select(F.explode(F.arrays_zip("p", "t")).alias("z")).select("z.p", "z.t")
        else:
            both = both.select("p", F.element_at("t", 1).alias("t"))
        if self.task == "regression":
            d = F.col("p") - F.col("t")
            of = {"rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)), "mape": F.avg(F.when(F.col("t") != 0, F.abs(d / F.col("t"))))}
            return both.agg(*[of[m].alias(m) for m in self.metrics]).first().asDict()
        counts = {(r["t"], r["p"]): r["n"] for r in both.groupBy("t", "p").agg(F.count("*").alias("n")).collect()}  # classes squared
        total, labels = sum(counts.values()), {x for k in counts for x in k}
        f = [2 * counts.get((c, c), 0) / (sum(n for (t, _), n in counts.items() if t == c) + sum(n for (_, p), n in counts.items() if p == c)) for c in labels]
        made = {"accuracy": sum(n for (t, p), n in counts.items() if t == p) / total if total else 0.0, "f1": sum(f) / len(f) if f else 0.0}
        return {m: made[m] for m in self.metrics}

    def transform(self, real: Series, **synthetic: Series) -> DataFrame:
        masks = {k.removesuffix("_mask"): synthetic.pop(k) for k in list(synthetic) if k.endswith("_mask")}

        def halves(name: str, x: Series) -> tuple[DataFrame, DataFrame]:
            df = row_index(_usable(x, masks.get(name)), x.time, "_rn")
            k = int(df.count() * self.train_test_split)
            return df.where(F.col("_rn") < k), df.where(F.col("_rn") >= k)

        def wires(df: DataFrame, x: Series) -> dict[str, Series]:
            n = F.size("x") - self.n_targets
            target = F.slice("x", n + 1, F.lit(self.n_targets))
            if self.task == "classification":
                target = F.element_at(target, 1)
            df = df.select(*x.index, F.slice("x", F.lit(1), n).alias("past"), target.alias("next"))
            return {"x": x.on(df, "past"), "target": x.on(df, "next")}

        data, out = wires(halves("real", real)[1], real), None
        truth = data["target"] if data["target"].is_array else data["target"].with_value(F.array("next"), "next")
        for name, s in {"real": real, **synthetic}.items():
            given, got = wires(halves(name, s)[0], s), []
            for k in range(self.repetitions):
                got.append(self._scores(self._model(k).fit(**given).transform(x=data["x"]), truth))
            for m in self.metrics:
                part = spread(real.df.sparkSession, f"{name}: {m}", [g[m] for g in got])
                out = part if out is None else out.unionByName(part)
        return out


class PlaneSummary(Operator):
    """Real and synthetic arrays in the plane by t-SNE (van der Maaten and Hinton, 2008) of a sample of ``max_points`` in all.

    Memory and time on the driver grow with the square of the sample: some
    3 GB at 10,000. Mask inputs end with ``_mask``.
    """

    def __init__(self, max_points: int = 10_000, perplexity: float = 30.0, rounds: int = 300, seed: int = 0, name: str = "TSNE") -> None:
        self.max_points, self.perplexity, self.rounds, self.seed, self.name = max_points, perplexity, rounds, seed, name

    def transform(self, gt: Series, **synthetic: Series) -> DataFrame:
        masks = {k.removesuffix("_mask"): synthetic.pop(k) for k in list(synthetic) if k.endswith("_mask")}
        parts = []
        each = max(1, self.max_points // (1 + len(synthetic)))
        for name, s in {"gt": gt, **synthetic}.items():
            rows = _usable(s, masks.get(name)).orderBy(F.xxhash64(s.time, F.lit(self.seed))).limit(each).select("x").collect()
            parts += [(name, r[0]) for r in rows]
        y = tsne(np.array([p[1] for p in parts], float), self.perplexity, self.rounds, self.seed)
        return gt.df.sparkSession.createDataFrame([(p[0], float(a), float(b)) for p, (a, b) in zip(parts, y)], "name string, x double, y double")


def tsne(x: np.ndarray, perplexity: float, rounds: int, seed: int) -> np.ndarray:
    n = len(x)
    square = (x * x).sum(1)
    d = np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0)
    p = np.zeros((n, n))
    goal = np.log(min(perplexity, max(2, (n - 1) / 3)))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        own = np.delete(d[i], i)
        for _ in range(50):
            e = np.exp(-(own - own.min()) * beta)
            q = e / e.sum()
            h = -(q * np.log(q + 1e-12)).sum()
            lo, hi = (beta, hi) if h > goal else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.RandomState(seed)
    y, v = rng.normal(0, 1e-4, (n, 2)), np.zeros((n, 2))
    for t in range(rounds):
        square = (y * y).sum(1)
        k = 1 / (1 + np.maximum(square[:, None] + square[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(k, 0)
        q = np.maximum(k / k.sum(), 1e-12)
        g = ((4.0 if t < 100 else 1.0) * p - q) * k
        v = (0.5 if t < 100 else 0.8) * v - 100.0 * (g.sum(1)[:, None] * y - g @ y)
        y = y + v
    return y - y.mean(0)
