"""Forecast errors, all predictions and time cuts in one aggregation, and class counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputNotAvailable, InvalidInput, WrongParameter
from ..frame import Series, align
from ..functions.windows import row_index
from .base import Estimator, Operator


def strict(agg: Column, v: Column, within: Column) -> Column:
    """An aggregate that is missing if any of its rows is."""
    return F.when(F.count_if(within & v.isNull()) == 0, agg)


class Metric(Operator):
    """Key and value rows: a value per prediction over everything after ``offset`` rows, and per cut (both ends included).

    ``filter_method(p, t)`` gives a Boolean Column of the rows that count.
    """

    def __init__(self, offset: int = 0, cuts: list[tuple[datetime, datetime]] | None = None, filter_method=None, name: str | None = None) -> None:
        self.offset, self.cuts, self.filter_method, self.name = offset, cuts, filter_method, name or type(self).__name__

    def value(self, p: Column, t: Column, within: Column) -> Column:
        raise NotImplementedError

    def prepare(self, df: DataFrame, s: Series) -> DataFrame:
        return df

    def transform(self, y: Series, **predictions: Series) -> DataFrame:
        if not predictions:
            raise InputNotAvailable("No predictions are given.", "Pass them by keyword besides y.")
        df, s = self._aligned(y, predictions)
        return _one_pass(self.prepare(df, s), self._parts(predictions, s))

    def _parts(self, predictions, s: Series) -> list[tuple[str, str, Column]]:
        parts = []
        for p in predictions:
            for suffix, within in [("", F.lit(True)), *self._cuts(s.time)]:
                rows = within & self.filter_method(F.col(p), F.col("_y")) if self.filter_method else within
                value = self.value(F.col(p).cast("double"), F.col("_y").cast("double"), rows)
                parts.append((self.name, p + suffix, F.struct(F.count_if(within).alias("n"), value.cast("double").alias("value"))))
        return parts

    def _aligned(self, y: Series, predictions: dict[str, Series]):
        """Truth as ``_y`` and predictions side by side, one value a row, after the offset."""
        flat = {"_y": y} | predictions
        df, s = align(flat)
        for n, x in flat.items():
            if x.is_array:
                if df.where(F.size(n) != 1).limit(1).count():
                    raise InvalidInput(f"{n} has more than one value a row.", "Metrics take one.")
                df = df.withColumn(n, F.element_at(n, 1))
        if self.offset:
            if s.keys:
                df = df.withColumn("_rn", F.row_number().over(s.window) - 1)
            else:
                df = row_index(df, s.time, "_rn")
            df = df.where(F.col("_rn") >= self.offset)
        return df, s

    def _cuts(self, time: str):
        for a, b in self.cuts or []:
            yield f": Cut from {a} to {b}", F.col(time).between(F.lit(a), F.lit(b))


def _one_pass(df: DataFrame, parts: list[tuple[str, str, Column]]) -> DataFrame:
    """All values in one aggregation; cuts without rows have none."""
    made = [F.struct(F.lit(m).alias("summary"), F.lit(k).alias("key"), v.alias("v")) for m, k, v in parts]
    rows = df.agg(F.array(*made).alias("all")).select(F.explode("all").alias("r"))
    rows = rows.select("r.summary", "r.key", F.col("r.v.value").alias("value"), "r.v.n")
    return rows.where((F.col("n") > 0) | ~F.col("key").contains(": Cut from ")).drop("n")


def evaluate(metrics: list[Metric], y: Series, **predictions: Series) -> DataFrame:
    """Several metrics of one offset in one pass over the data; averaged F1 scores, which count by class, have their own."""
    if len({m.offset for m in metrics}) > 1 or any(isinstance(m, F1Score) and m.average in ("macro", "weighted") for m in metrics):
        raise WrongParameter("These metrics can't share a pass.", "Call those of other offsets, and averaged F1 scores, by themselves.")
    df, s = metrics[0]._aligned(y, predictions)
    parts = []
    for m in metrics:
        if isinstance(m, MASE):
            m._starts = {}
        df = m.prepare(df, s)
        parts += m._parts(predictions, s)
    return _one_pass(df, parts)


class MAE(Metric):
    def value(self, p, t, within):
        return strict(F.avg(F.when(within, F.abs(p - t))), p - t, within)


class RMSE(Metric):
    def value(self, p, t, within):
        return strict(F.sqrt(F.avg(F.when(within, (p - t) * (p - t)))), p - t, within)


class MAPE(Metric):
    """In per cent, over rows whose truth isn't 0."""

    def value(self, p, t, within):
        return strict(100 * F.avg(F.when(within & (t != 0), F.abs((p - t) / t))), p - t, within)


class MaxErr(Metric):
    def value(self, p, t, within):
        return strict(F.max(F.when(within, F.abs(p - t))), p - t, within)


class MinErr(Metric):
    def value(self, p, t, within):
        return strict(F.min(F.when(within, F.abs(p - t))), p - t, within)


class MASE(Metric):
    """Mean absolute error after ``lag`` rows, over that of the naive forecast ``lag`` rows back; rows count within each cut."""

    def __init__(self, lag: int = 1, offset: int = 0, cuts=None, filter_method=None, name: str | None = None) -> None:
        super().__init__(offset, cuts, filter_method, name)
        self.lag = lag

    def prepare(self, df: DataFrame, s: Series) -> DataFrame:
        lagged = lambda c: F.lag(c, self.lag).over(s.window)
        return df.withColumn("_back", lagged("_y")).withColumn("_when", lagged(s.time))

    def _cuts(self, time: str):
        self._starts = {}
        for a, b in self.cuts or []:
            within = F.col(time).between(F.lit(a), F.lit(b))
            self._starts[str(within)] = a
            yield f": Cut from {a} to {b}", within

    def transform(self, y: Series, **predictions: Series) -> DataFrame:
        self._starts = {}
        return super().transform(y, **predictions)

    def value(self, p, t, within):
        start = self._starts.get(str(within))
        inside = F.col("_when").isNotNull() if start is None else F.coalesce(F.col("_when") >= F.lit(start), F.lit(False))
        rows = within & inside
        naive = F.avg(F.when(rows, F.abs(t - F.col("_back"))))
        return strict(F.avg(F.when(rows, F.abs(p - t))) / naive, p - t, within)


def class_counts(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(truth).cast("int").alias("t"), F.col(prediction).cast("int").alias("p")).agg(F.count("*").alias("n"))


class F1Score(Metric):
    """micro, macro, weighted (by predictions, as the classes are passed the other way round) or binary (class 1)."""

    def __init__(self, average: str = "micro", offset: int = 0, cuts=None, filter_method=None, name: str | None = None) -> None:
        if average not in ("micro", "macro", "weighted", "binary"):
            raise WrongParameter(f"average={average!r} is unknown.", "Use micro, macro, weighted or binary.")
        super().__init__(offset, cuts, filter_method, name)
        self.average = average

    def value(self, p, t, within):
        if self.average == "micro":
            return F.avg(F.when(within, (p == t).cast("double")))
        tp, fp, fn = (F.count_if(within & c) for c in ((p == 1) & (t == 1), (p == 1) & (t != 1), (p != 1) & (t == 1)))
        return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)

    def transform(self, y: Series, **predictions: Series) -> DataFrame:
        if self.average in ("micro", "binary"):
            return super().transform(y, **predictions)
        if not predictions:
            raise InputNotAvailable("No predictions are given.", "Pass them by keyword besides y.")
        df, s = self._aligned(y, predictions)
        out = None
        for p in predictions:
            for suffix, within in [("", F.lit(True)), *self._cuts(s.time)]:
                if self.filter_method:
                    within = within & self.filter_method(F.col(p), F.col("_y"))
                c = class_counts(df.where(within), "_y", p)
                side = c.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(1).alias("side"), "n"), F.struct(F.col("p").alias("c"), F.lit(2).alias("side"), "n"), F.struct(F.when(F.col("t") == F.col("p"), F.col("t")).alias("c"), F.lit(3).alias("side"), "n"))).alias("x"))
                total = lambda k: F.sum(F.when(F.col("x.side") == k, F.col("x.n")).otherwise(0))
                per = side.where("x.c is not null").groupBy("x.c").agg((2.0 * total(3) / (total(1) + total(2))).alias("f"), total(2).alias("w"))
                f = F.avg("f") if self.average == "macro" else F.sum(F.col("f") * F.col("w")) / F.sum("w")
                row = per.agg(f.alias("value")).select(F.lit(self.name).alias("summary"), F.lit(p + suffix).alias("key"), "value")
                out = row if out is None else out.unionByName(row)
        return out


class ConfusionMatrix(Operator):
    """A row per true class, a column per predicted one, over the union of both; ``transform`` gives them long, with zeros."""

    def __init__(self, name: str = "ConfusionMatrix") -> None:
        self.name = name

    def transform(self, gt: Series, **predictions: Series) -> DataFrame:
        if not predictions:
            raise InputNotAvailable("No predictions are given.", "Pass them by keyword besides gt.")
        df, _ = align({"_y": gt} | predictions)
        out = None
        for p in predictions:
            c = class_counts(df, "_y", p)
            labels = c.select(F.explode(F.array("t", "p")).alias("label")).agg(F.collect_set("label").alias("all"))  # the classes
            grid = labels.select("all", F.explode("all").alias("t")).select("t", F.explode("all").alias("p"))
            full = grid.join(c, ["t", "p"], "left").select(F.lit(p).alias("prediction"), F.col("t").alias("gt"), F.col("p").alias("pred"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            out = full if out is None else out.unionByName(full)
        return out


class Ensemble(Estimator):
    """Weighted mean of forecasts. Weights: None (equal), ``auto`` (1 / loss) or a list; ``k_best``: None, ``auto`` or a number.

    All losses are one aggregation; the weights are few numbers on the driver.
    """

    def __init__(self, weights=None, k_best=None, loss_metric: str = "RMSE", name: str = "Ensemble") -> None:
        if loss_metric not in ("RMSE", "MAE"):
            raise WrongParameter(f"Loss {loss_metric!r} is unknown.", "Use RMSE or MAE.")
        self.weights, self.k_best, self.loss_metric, self.name = weights, k_best, loss_metric, name

    def fit(self, **inputs: Series) -> Ensemble:
        import numpy as np

        forecasts = {k: v for k, v in inputs.items() if not k.startswith("target")}
        targets = {k: v for k, v in inputs.items() if k.startswith("target")}
        n = len(forecasts)
        if isinstance(self.weights, (list, tuple)) and len(self.weights) != n:
            raise WrongParameter(f"{len(self.weights)} weights for {n} forecasts.", "Give a weight for each.")
        if isinstance(self.k_best, int) and self.k_best > n:
            raise WrongParameter(f"k_best is {self.k_best}, of {n} forecasts.", "It must not exceed them.")
        if self.weights is None and self.k_best is None:
            self.state = {"weights": None}
            return self
        loss = np.ones(n)
        if self.weights == "auto" or self.k_best is not None:
            df, _ = align(forecasts | targets)
            one = lambda d: F.avg(F.abs(d)) if self.loss_metric == "MAE" else F.sqrt(F.avg(d * d))
            row = df.agg(*[one(F.col(f) - F.col(t)).alias(f"{f}|{t}") for f in forecasts for t in targets]).first()
            loss = np.array([np.mean([row[f"{f}|{t}"] for t in targets]) for f in forecasts])
        keep = np.ones(n, bool)
        if self.k_best == "auto":
            q1, q3 = np.percentile(loss, [25, 75])
            keep = loss <= q3 + 1.5 * (q3 - q1)
        elif self.k_best is not None:
            keep[np.argsort(loss, kind="stable")[self.k_best :]] = False
        if self.weights == "auto":
            w = np.where(loss == 0, 1.0, 0.0) if (loss == 0).any() else 1.0 / loss
        else:
            w = np.ones(n) if self.weights is None else np.array(self.weights, float)
        w = np.where(keep, w, 0.0)
        self.state = {"weights": (w / w.sum()).tolist()}
        return self

    def transform(self, **inputs: Series) -> Series:
        from .preprocessing import weighted_mean

        forecasts = {k: v for k, v in inputs.items() if not k.startswith("target")}
        return weighted_mean(forecasts, (self.state or {}).get("weights") or [1.0] * len(forecasts))
