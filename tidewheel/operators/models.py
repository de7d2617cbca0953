"""Fitted operators: scaler, feature choice, linear models, clusters, autoregression and adapters for functions."""

from __future__ import annotations

import importlib
import json
import os

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import UnknownTransform, WrongParameter
from ..frame import Series, align
from ..functions.windows import micros
from .base import Estimator, split_inputs


def flat(inputs: dict[str, Series]) -> tuple:
    """One frame with the inputs side by side in an array ``x``; array inputs are laid out."""
    df, s = align(inputs)
    parts = [F.col(n).cast("array<double>") if v.is_array else F.array(F.col(n).cast("double")) for n, v in inputs.items()]
    return df.withColumn("x", F.concat(*parts)), s


class StandardScaler(Estimator):
    """Mean 0 and population variance 1; constant inputs give 0."""

    has_inverse_transform = True

    def __init__(self, with_mean: bool = True, with_std: bool = True, name: str = "StandardScaler") -> None:
        self.with_mean, self.with_std, self.name = with_mean, with_std, name

    def fit(self, x: Series, **_) -> StandardScaler:
        v = F.explode(F.col(x.col).cast("array<double>")) if x.is_array else F.col(x.col).cast("double")
        r = x.df.select(v.alias("v")).agg(F.avg("v"), F.stddev_pop("v")).first()
        self.state = {"mean": r[0] if self.with_mean else 0.0, "std": (r[1] or 1.0) if self.with_std else 1.0}
        return self

    def _map(self, x: Series, f) -> Series:
        return x.with_value(F.transform(x.col, f) if x.is_array else f(F.col(x.col)))

    def transform(self, x: Series, **_) -> Series:
        return self._map(x, lambda v: (v - self.state["mean"]) / self.state["std"])

    def inverse_transform(self, x: Series, **_) -> Series:
        return self._map(x, lambda v: v * self.state["std"] + self.state["mean"])


class SelectKBest(Estimator):
    """The k features with the largest F of a simple regression on the target."""

    def __init__(self, k: int = 10, name: str = "SelectKBest") -> None:
        self.k, self.name = k, name

    def fit(self, **inputs: Series) -> SelectKBest:
        xs, targets = split_inputs(inputs)
        df, _ = align(inputs)
        parts = [F.col(n).cast("array<double>") if v.is_array else F.array(F.col(n).cast("double")) for n, v in xs.items()]
        target = next(iter(targets))
        y = F.element_at(target, 1) if targets[target].is_array else F.col(target)
        df = df.select(F.concat(*parts).alias("x"), y.cast("double").alias("y"))
        width = df.select(F.max(F.size("x"))).first()[0]
        r = df.agg(*[F.corr(F.get("x", F.lit(i)), "y") for i in range(width)]).first()
        score = [0.0 if c is None else c * c for c in r]
        self.state = {"keep": sorted(np.argsort(-np.array(score), kind="stable")[: self.k].tolist())}
        return self

    def transform(self, **inputs: Series) -> Series:
        xs, _ = split_inputs(inputs)
        df, s = flat(xs)
        return s.on(df).with_value(F.array(*[F.get("x", F.lit(i)) for i in self.state["keep"]]), "selected")


class LinearRegression(Estimator):
    """Least squares for any number of targets and horizons: one aggregation of the Gram matrix, solved on the driver."""

    def __init__(self, ridge: float = 0.0, name: str = "LinearRegression") -> None:
        self.ridge, self.name = ridge, name

    def fit(self, **inputs: Series) -> LinearRegression:
        xs, targets = split_inputs(inputs)
        df, _ = align(inputs)
        lay = lambda part: F.concat(*[F.col(n).cast("array<double>") if v.is_array else F.array(F.col(n).cast("double")) for n, v in part.items()])
        sizes = {n: (df.select(F.max(F.size(n))).first()[0] if v.is_array else 1) for n, v in targets.items()}
        z = df.select(F.concat(F.array(F.lit(1.0)), lay(xs), lay(targets)).alias("z")).where(F.forall("z", lambda v: v.isNotNull()))

        def gram(batches):
            import pandas as pd

            total = None
            for pdf in batches:
                m = np.array(pdf["z"].tolist(), float)
                if len(m):
                    total = m.T @ m if total is None else total + m.T @ m
            if total is not None:
                yield pd.DataFrame({"i": np.repeat(np.arange(len(total)), len(total)), "j": np.tile(np.arange(len(total)), len(total)), "v": total.ravel()})

        g = z.mapInPandas(gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # width squared rows
        n = int(g["i"].max()) + 1
        m = np.zeros((n, n))
        m[g["i"], g["j"]] = g["v"]
        p = n - sum(sizes.values())
        a = m[:p, :p] + self.ridge * np.diag([0.0] + [1.0] * (p - 1))
        self.state = {"coef": np.linalg.lstsq(a, m[:p, p:], rcond=None)[0].tolist(), "targets": sizes}
        return self

    def transform(self, **inputs: Series) -> Series | dict[str, Series]:
        xs, _ = split_inputs(inputs)
        df, s = flat(xs)
        coef, at, out, cols = self.state["coef"], 0, {}, []
        for n, size in self.state["targets"].items():
            made = []
            for k in range(at, at + size):
                w = F.array(*[F.lit(float(r[k])) for r in coef[1:]])
                made.append(F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(float(coef[0][k])), lambda t, v: t + v))
            cols.append((made[0] if size == 1 else F.array(*made)).alias(n))
            at += size
        done = df.select(*s.index, *cols)
        out = {n: s.on(done, n) for n in self.state["targets"]}
        return out if len(out) > 1 else next(iter(out.values()))


class SparkModel(Estimator):
    """Adapter of a ``pyspark.ml`` estimator: features from the inputs, each target as the label of a model of its own.

    Rows with a missing feature have no prediction: they aren't in the result,
    and don't count in a fit. A model without a target is one. With several
    targets the result is a dict by their names.
    """

    has_predict_proba = True

    def __init__(self, module, name: str | None = None) -> None:
        self.module, self.name = module, name or type(module).__name__
        self.model: dict | None = None

    def _frame(self, inputs: dict[str, Series]):
        xs, targets = split_inputs(inputs)
        df, s = align(inputs)
        parts = [F.col(n).cast("array<double>") if v.is_array else F.array(F.col(n).cast("double")) for n, v in xs.items()]
        df = df.withColumn("_x", F.concat(*parts))
        width = df.select(F.max(F.size("_x"))).first()[0]
        df = df.select(*s.index, *targets, *[F.get("_x", F.lit(i)).alias(f"_x{i}") for i in range(width or 0)])
        df = df.where(F.forall(F.array(*[f"_x{i}" for i in range(width or 0)]), lambda v: v.isNotNull()))
        df = VectorAssembler(inputCols=[f"_x{i}" for i in range(width or 0)], outputCol="features").transform(df)
        return df, s

    def fit(self, **inputs: Series) -> SparkModel:
        df, _ = self._frame(inputs)
        targets = split_inputs(inputs)[1]
        labelled = lambda t: df.withColumn("label", F.col(t).cast("double")).where(F.col(t).isNotNull())
        self.model = {t: self.module.fit(labelled(t)) for t in targets} or {"": self.module.fit(df)}
        return self

    def transform(self, **inputs: Series) -> Series | dict[str, Series]:
        df, s = self._frame(split_inputs(inputs)[0])
        out = {}
        for t, model in (self.model or {"": None}).items():
            if not hasattr(model, "transform"):
                raise UnknownTransform(f"{self.name} can't transform.", "Use a model with a prediction, and fit it.")
            made = model.transform(df)
            col = next((c for c in ("prediction", "output") if c in made.columns), None)
            if col is None and hasattr(self.module, "getOutputCol"):  # selectors and scalers
                col = self.module.getOutputCol()
                made = made.withColumn(col, vector_to_array(col))
            if col is None:
                raise UnknownTransform(f"{self.name} has no prediction.", f"It gave {made.columns}.")
            out[t] = s.on(made.select(*s.index, F.col(col).alias(t or col)), t or col)
        return out if len(out) > 1 else next(iter(out.values()))

    def predict_proba(self, **inputs: Series) -> Series:
        df, s = self._frame(split_inputs(inputs)[0])
        model = next(iter(self.model.values()))
        return s.on(model.transform(df).select(*s.index, vector_to_array("probability").alias("probability")), "probability")

    def save_model(self, path: str) -> None:
        os.makedirs(path)
        own = {k: v for k, v in self.get_params().items() if k != "module"}
        with open(os.path.join(path, "own.json"), "w") as f:
            json.dump({"params": own, "targets": None if self.model is None else list(self.model), "module": "module" in self.get_params()}, f)
        uri = f"file://{os.path.abspath(path)}"
        if "module" in self.get_params():
            self.module.write().overwrite().save(f"{uri}/module")
        for k, m in enumerate((self.model or {}).values()):
            m.write().overwrite().save(f"{uri}/model{k}")

    @classmethod
    def load_model(cls, path: str) -> SparkModel:
        from pyspark.ml.util import DefaultParamsReader

        uri = f"file://{os.path.abspath(path)}"
        with open(os.path.join(path, "own.json")) as f:
            d = json.load(f)
        get = lambda name: _loaded(f"{uri}/{name}", DefaultParamsReader)
        out = cls(get("module"), **d["params"]) if d["module"] else cls(**d["params"])
        if d["targets"] is not None:
            out.model = {t: get(f"model{k}") for k, t in enumerate(d["targets"])}
        return out


def _loaded(uri: str, reader):
    """A saved object of ``pyspark.ml``, by the class in its metadata."""
    from pyspark.sql import SparkSession

    kind = reader.loadMetadata(uri, SparkSession.active())["class"]
    if kind.startswith("org.apache.spark.ml."):
        kind = "pyspark.ml." + kind.removeprefix("org.apache.spark.ml.")
    where, name = kind.rsplit(".", 1)
    if not where.startswith("pyspark.ml"):
        raise WrongParameter(f"{kind} is no class of pyspark.ml.", "Only such are loaded.")
    module = importlib.import_module(".".join(where.split(".")[:3]))
    return getattr(module, name).load(uri)


class KMeansDistances(SparkModel):
    """Distances to the cluster centres, an array a row; ``given`` centres aren't fitted."""

    def __init__(self, k: int = 2, seed: int = 0, given: list[list[float]] | None = None, name: str = "KMeans") -> None:
        super().__init__(KMeans(k=k, seed=seed), name)
        self.k, self.seed, self.given = k, seed, given

    def centers(self) -> list:
        return self.given or next(iter(self.model.values())).clusterCenters()

    def fit(self, **inputs: Series) -> KMeansDistances:
        return self if self.given else super().fit(**split_inputs(inputs)[0])

    def transform(self, **inputs: Series) -> Series:
        df, s = self._frame(split_inputs(inputs)[0])
        x = vector_to_array(F.col("features"))
        far = lambda c: F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
        return s.on(df.select(*s.index, F.array(*[far(c) for c in self.centers()]).alias("distances")), "distances")


class Mixture(SparkModel):
    """Component of a Gaussian mixture."""

    def __init__(self, k: int = 2, seed: int = 0, name: str = "GaussianMixture") -> None:
        super().__init__(GaussianMixture(k=k, seed=seed), name)
        self.k, self.seed = k, seed


class AutoRegression(Estimator):
    """AR(p), with other inputs as regressors, by least squares over lagged values; ``transform`` predicts one step from the true past."""

    def __init__(self, p: int = 2, name: str = "AutoRegression") -> None:
        if p < 1:
            raise WrongParameter("p is below 1.", f"It is {p}.")
        self.p, self.name = p, name
        self.inner = LinearRegression()

    def _lags(self, y: Series) -> Series:
        return y.with_value(F.array(*[F.lag(y.col, k).over(y.window) for k in range(1, self.p + 1)]), "lags")

    def fit(self, target: Series, **inputs: Series) -> AutoRegression:
        self.inner.fit(target=target, lags=self._lags(target), **inputs)
        self.state = self.inner.state
        return self

    def transform(self, target: Series, **inputs: Series) -> Series:
        self.inner.state = self.state
        return self.inner.transform(lags=self._lags(target), **inputs)


    def forecast(self, target: Series, n: int) -> Series:
        """The next n values of each series, each from those before it; other inputs aren't supported. Steps are as long as the last one."""
        if len(self.state["coef"]) != self.p + 1:
            raise WrongParameter("The model has other inputs.", "Their future isn't known.")
        need = max(self.p, 2)
        if target.keys:
            down = Window.partitionBy(*target.keys).orderBy(F.col(target.time).desc())
            last = target.df.withColumn("_k", F.row_number().over(down)).where(F.col("_k") <= need)
        else:
            last = target.df.orderBy(F.col(target.time).desc()).limit(need)
        kind = dict(target.df.dtypes)[target.time]
        us = micros(target.time)
        rows = F.reverse(F.array_sort(F.collect_list(F.struct(us.alias("t"), F.col(target.col).cast("double").alias("v")))))
        one = last.groupBy(*target.keys).agg(rows.alias("_r")).where(F.size("_r") >= need)
        c = [float(r[0]) for r in self.state["coef"]]
        new = lambda a: sum((F.get(a, F.lit(k)) * F.lit(c[k + 1]) for k in range(self.p)), F.lit(c[0]))
        past = F.transform(F.slice("_r", 1, self.p), lambda x: x["v"])
        made = F.aggregate(F.sequence(F.lit(1), F.lit(n)), past, lambda a, _: F.concat(F.array(new(a)), a))
        made = F.reverse(F.slice(made, 1, n))
        step = F.get("_r", F.lit(0))["t"] - F.get("_r", F.lit(1))["t"]
        out = one.select(*target.keys, F.get("_r", F.lit(0))["t"].alias("_t"), step.alias("_step"), F.posexplode(made).alias("_i", "_v"))
        time = F.timestamp_micros(F.col("_t") + F.col("_step") * (F.col("_i") + 1)).cast(kind)
        return target.on(out.select(*target.keys, time.alias(target.time), F.col("_v").alias(target.col)))


class RandomFourier:
    """Random features whose products approach a Gaussian kernel (Rahimi and Recht, 2007), of inputs scaled to deviation 1."""

    def __init__(self, mean: list, std: list, features: int, gamma: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.std = np.array(mean, float), np.array(std, float)
        self.w = rng.standard_normal((len(mean), features)) * np.sqrt(2 * gamma)
        self.b = rng.uniform(0, 2 * np.pi, features)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.b)) * np.cos((x - self.mean) / self.std @ self.w + self.b)


class KernelMachine(Estimator):
    """Least-squares support vector machine (Suykens and Vandewalle, 1999) over random Fourier features.

    The Gram matrix of the features is one aggregation, so any number of rows
    is used. ``gamma``: of the Gaussian kernel, by default 1 / width. Rows
    with a missing element don't count, and have no prediction.
    """

    classes = False

    def __init__(self, C: float = 1.0, gamma: float | None = None, features: int = 256, seed: int = 0, name: str | None = None) -> None:
        if C <= 0 or features < 1:
            raise WrongParameter("C and features must be positive.", f"They are {C} and {features}.")
        self.C, self.gamma, self.features, self.seed, self.name = C, gamma, features, seed, name or type(self).__name__

    def _map(self) -> RandomFourier:
        return RandomFourier(self.state["mean"], self.state["std"], self.features, self.state["gamma"], self.seed)

    def fit(self, **inputs: Series) -> KernelMachine:
        xs, targets = split_inputs(inputs)
        df, s = flat(inputs)
        wide = flat(xs)[0].select(F.max(F.size("x"))).first()[0]
        target = next(iter(targets))
        y = F.element_at(target, 1) if targets[target].is_array else F.col(target)
        df = df.select(F.slice("x", 1, wide).alias("x"), y.cast("double").alias("y")).where("y is not null").where(F.forall("x", lambda v: v.isNotNull()))
        r = df.agg(*[f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(wide)]).first()
        self.state = {"mean": list(r[:wide]), "std": [v or 1.0 for v in r[wide:]], "gamma": self.gamma or 1.0 / wide, "target": target}
        if self.classes:
            self.state["classes"] = sorted(x[0] for x in df.select("y").distinct().limit(1000).collect())
        labels, features = self.state.get("classes"), self._map()

        def gram(batches):
            import pandas as pd

            total = None
            for pdf in batches:
                if len(pdf):
                    v = pdf["y"].to_numpy()
                    t = v[:, None] if labels is None else np.where(v[:, None] == np.array(labels), 1.0, -1.0)
                    z = np.concatenate([np.ones((len(v), 1)), features.of(np.array(pdf["x"].tolist(), float)), t], 1)
                    total = z.T @ z if total is None else total + z.T @ z
            if total is not None:
                n = len(total)
                yield pd.DataFrame({"i": np.repeat(np.arange(n), n), "j": np.tile(np.arange(n), n), "v": total.ravel()})

        g = df.mapInPandas(gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # width squared rows
        n, p = int(g["i"].max()) + 1, self.features + 1
        m = np.zeros((n, n))
        m[g["i"], g["j"]] = g["v"]
        self.state["coef"] = np.linalg.solve(m[:p, :p] + np.diag([1e-9] + [1 / self.C] * (p - 1)), m[:p, p:]).tolist()
        return self

    def transform(self, **inputs: Series) -> Series:
        xs, _ = split_inputs(inputs)
        df, s = flat(xs)
        coef, labels, features = np.array(self.state["coef"]), self.state.get("classes"), self._map()

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            got = coef[0] + features.of(np.array(x.tolist(), float).reshape(len(x), -1)) @ coef[1:]
            return pd.Series(got[:, 0] if labels is None else np.array(labels, float)[got.argmax(1)])

        whole = df.where(F.forall("x", lambda v: v.isNotNull()))
        return s.on(whole.select(*s.index, predict("x").alias(self.state["target"])), self.state["target"])


class SVR(KernelMachine):
    """Kernel regression; see :class:`KernelMachine`."""


class SVC(KernelMachine):
    """Kernel classification, one class against the others; numeric labels, at most 1,000 of them."""

    classes = True


class FunctionModule(Estimator):
    """User functions: ``transform_method(**inputs)``, and ``fit_method(**inputs)`` if there is one."""

    def __init__(self, transform_method, fit_method=None, name: str = "FunctionModule") -> None:
        self.transform_method, self.fit_method, self.name = transform_method, fit_method, name
        self.state = {} if fit_method is None else None

    def fit(self, **inputs):
        if self.fit_method:
            self.fit_method(**inputs)
        self.state = {}
        return self

    def transform(self, **inputs):
        return self.transform_method(**inputs)
