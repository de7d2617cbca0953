"""Anomalies and concept drifts put into a series. Places are drawn on the driver from the row count alone; rows are changed by a join."""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import WrongParameter
from ..frame import Series
from ..functions.windows import micros, row_index, running_sum
from .base import Operator


@dataclass
class Draws:
    """Start and length of each anomaly, and the random numbers of each."""

    starts: list[int]
    lengths: list[int]
    rng: np.random.RandomState
    columns: dict[str, list[float]] = field(default_factory=dict)


class Taken:
    """Closed intervals of rows that are in use, kept sorted and apart."""

    def __init__(self, intervals: list[tuple[int, int]]) -> None:
        self.begin, self.end = [list(x) for x in zip(*sorted(intervals))] if intervals else ([], [])

    def add(self, first: int, last: int) -> bool:
        """Take an interval; False if some of it is taken."""
        i = bisect.bisect_right(self.begin, last)
        if i and self.end[i - 1] >= first:
            return False
        self.begin.insert(i, first)
        self.end.insert(i, last)
        return True

    def gaps(self, n: int):
        at = 0
        for a, b in zip([*self.begin, n], [*self.end, n]):
            if a > at:
                yield at, a
            at = max(at, b + 1)


def place(n: int, count: float, taken: list[tuple[int, int]], rng: np.random.RandomState, distribution: str = "uniform", mean: float = 1, std: float = 0, min: int = 1, max: int = 1) -> tuple[list[int], list[int]]:
    """Free, non-overlapping places for the anomalies of a series of n rows; an error if they don't fit.

    Places are drawn until one is free; where that fails often, one is drawn
    from all that are free.
    """
    quantity = count if isinstance(count, int) else int(count * n)
    if distribution == "uniform":
        lengths = rng.uniform(min, max, quantity)
    elif distribution == "normal":
        lengths = rng.normal(mean, std, quantity)
    else:
        raise WrongParameter(f"Distribution {distribution!r} is unknown.", "Use uniform or normal.")
    lengths = np.maximum(1, np.round(lengths)).astype(int).tolist()
    starts, used = [], Taken(taken)
    for size in lengths:
        for _ in range(30):
            i = int(rng.randint(n - size + 1)) if size <= n else 0
            if size <= n and used.add(i, i + size - 1):
                break
        else:
            free = [(a, b - size + 1) for a, b in used.gaps(n) if b - a >= size]
            if not free:
                raise WrongParameter(f"No place is left for an anomaly of {size} rows.", "Use fewer or shorter ones.")
            k = int(rng.randint(sum(b - a for a, b in free)))
            for a, b in free:
                if k < b - a:
                    break
                k -= b - a
            i = a + k
            used.add(i, i + size - 1)
        starts.append(i)
    return starts, lengths


def _runs(labelled: DataFrame) -> list[tuple[int, int]]:
    """First and last rows of runs of labelled rows: two numbers a run reach the driver."""
    rows = labelled.select("rn")
    first = rows.join(rows.select((F.col("rn") + 1).alias("rn")), "rn", "left_anti")
    last = rows.join(rows.select((F.col("rn") - 1).alias("rn")), "rn", "left_anti")
    return list(zip(sorted(r[0] for r in first.collect()), sorted(r[0] for r in last.collect())))


class AnomalyGeneration(Operator):
    """Kinds: gap, constant, negate, outlier, lag. ``transform`` gives the changed series and ``labels``.

    A kind is a method ``_anomaly_<kind>(draws, **params)`` that returns the
    new value as a Column over ``v`` (the value), ``k`` and ``len`` (place in
    the anomaly and its length), ``x0`` (value at its start), ``before`` (value
    before its start) and what ``draws.columns`` adds; subclasses add kinds.
    ``places`` gives (first row, number of rows) of each anomaly instead of
    drawing them. A row an anomaly is on the driver; the series isn't.
    """

    prefix_sum = False

    def __init__(self, count: float = 1, anomaly: str = "gap", anomaly_params: dict | None = None, length_params: dict | None = None, label: int | None = None, seed: int = 0, places: list | None = None, name: str | None = None) -> None:
        kinds = sorted(m.removeprefix("_anomaly_") for m in dir(type(self)) if m.startswith("_anomaly_"))
        if anomaly not in kinds:
            raise WrongParameter(f"Anomaly {anomaly!r} is unknown.", f"Use one of {kinds}.")
        self.count, self.anomaly, self.anomaly_params, self.length_params = count, anomaly, anomaly_params or {}, length_params or {}
        self.label, self.seed, self.places, self.name = label, seed, places, name or type(self).__name__

    def transform(self, x: Series, labels: Series | None = None) -> dict[str, Series]:
        df = x.df.select(*x.index, F.col(x.col).cast("double").alias("v"))
        if labels is not None:
            df = df.join(labels.df.select(*x.index, F.col(labels.col).cast("int").alias("label")), x.index, "left")
        else:
            df = df.withColumn("label", F.lit(0))
        df = row_index(df, x.time, "rn").persist()
        n = df.count()
        top = df.agg(F.max("label")).first()[0] or 0
        rng = np.random.RandomState(self.seed)
        if self.places is not None:
            starts, lengths = [int(a) for a, _ in self.places], [int(k) for _, k in self.places]
            if any(a < 0 or k < 1 or a + k > n for a, k in self.places):
                raise WrongParameter("A place is outside of the series.", f"It has {n} rows.")
        else:
            starts, lengths = place(n, self.count, _runs(df.where("label <> 0")) if top else [], rng, **self.length_params)
        draws = Draws(starts, lengths, rng)
        self._stats = df.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")).first()
        value = getattr(self, f"_anomaly_{self.anomaly}")(draws, **self.anomaly_params)
        names = ["s", "len", *draws.columns]
        rows = [(int(s), int(k), *(float(c[i]) for c in draws.columns.values())) for i, (s, k) in enumerate(zip(starts, lengths))]
        table = df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c in ('s', 'len') else 'double'}" for c in names))
        series = df.select("rn", "v")
        at = table.join(series.select(F.col("rn").alias("s"), F.col("v").alias("x0")), "s", "left")
        at = at.join(series.select((F.col("rn") + 1).alias("s"), F.col("v").alias("before")), "s", "left")
        if self.prefix_sum:
            sums = running_sum(series, "v", "prefix", own=False)
            at = at.join(sums.select(F.col("rn").alias("s"), "prefix"), "s", "left")
        each = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("len") - 1))).withColumn("rn", F.col("s") + F.col("k"))
        inside = each.join(series, "rn")
        sums = inside.groupBy("s").agg(F.sum("v").alias("total"), F.min("v").alias("low"))
        inside = inside.join(sums, "s")
        changed = inside.select("rn", value.alias("new"), F.lit(True).alias("hit"))
        new_label = self.label if self.label is not None else top + 1
        out = df.join(changed, "rn", "left")
        shift = self._shift(draws)
        if shift:
            steps = df.sparkSession.createDataFrame([(int(s), float(c)) for s, c in shift], "s long, step double")
            amount = at.join(steps, "s").select(F.col("s").alias("rn"), (F.col("step") * F.abs(F.col("x0") - F.col("before"))).alias("amount"))
            moved = running_sum(series.select("rn").join(amount, "rn", "left"), "amount", "shift")
            out = out.join(moved.select("rn", "shift"), "rn")
            value_out = F.col("v") + F.col("shift")
        else:
            value_out = F.when(F.col("hit"), F.col("new")).otherwise(F.col("v"))
        out = out.select(*x.index, value_out.alias(x.col), F.when(F.col("hit"), new_label).otherwise(F.col("label")).cast("int").alias("labels"))
        return {x.col: x.on(out.select(*x.index, x.col)), "labels": x.on(out.select(*x.index, "labels"), "labels")}

    def _shift(self, draws: Draws) -> list[tuple[int, float]]:
        return []

    def _anomaly_gap(self, draws: Draws) -> Column:
        return F.lit(None).cast("double")

    def _anomaly_constant(self, draws: Draws, constant="last") -> Column:
        if constant == "last":
            return F.col("x0")
        if constant == "random":
            lo, hi = int(self._stats["min"]), max(int(self._stats["max"]), int(self._stats["min"]) + 1)
            draws.columns["c"] = draws.rng.randint(lo, hi, len(draws.starts)).tolist()
            return F.col("c")
        if isinstance(constant, bool) or not isinstance(constant, (int, float)):
            raise WrongParameter(f"constant={constant!r} is unknown.", "Use a number, last or random.")
        return F.lit(float(constant))

    def _anomaly_negate(self, draws: Draws) -> Column:
        return -F.col("v")

    def _anomaly_outlier(self, draws: Draws, outlier_type: str = "std", outlier_sign: str | None = None, random: bool = True, limits: tuple[float, float] = (2, 4)) -> Column:
        """The factor is limits[0] plus a random share of limits[1]."""
        if outlier_type not in ("std", "mean", "multiple"):
            raise WrongParameter(f"outlier_type={outlier_type!r} is unknown.", "Use std, mean or multiple.")
        if outlier_sign not in (None, "positive", "negative"):
            raise WrongParameter(f"outlier_sign={outlier_sign!r} is unknown.", "Use positive, negative or None.")
        n = len(draws.starts)
        factor = [limits[0] + draws.rng.rand() * limits[1] if random else float(limits[0]) for _ in range(n)]
        sign = [1.0 if outlier_sign == "positive" or (outlier_sign is None and draws.rng.rand() > 0.5) else -1.0 for _ in range(n)]
        draws.columns["f"] = [a * b for a, b in zip(factor, sign)]
        mean, std = float(self._stats["mean"]), float(self._stats["std"])
        return {"std": F.lit(mean) + F.col("f") * std, "mean": F.col("f") * mean, "multiple": F.col("v") * F.col("f")}[outlier_type]

    def _anomaly_lag(self, draws: Draws) -> Column:
        return F.when(F.col("k") == F.col("len") - 1, F.col("v")).otherwise(0.0)


class EnergyAnomalyGeneration(AnomalyGeneration):
    """type1: zero; type2: hold the value before; type3 and type4: lower or raise all later rows."""

    def _anomaly_type1(self, draws: Draws) -> Column:
        return F.lit(0.0)

    def _anomaly_type2(self, draws: Draws, softstart: bool = False) -> Column:
        self._edge(draws)
        if not softstart:
            return F.col("before")
        draws.columns["r"] = draws.rng.rand(len(draws.starts)).tolist()
        return F.when(F.col("k") == 0, F.col("r") * F.col("x0") + (1 - F.col("r")) * F.col("before")).otherwise(F.col("before"))

    def _steps(self, draws: Draws, sign: float, range_r, extreme: bool = False) -> Column:
        self._edge(draws)
        if any(k > 1 for k in draws.lengths):
            raise WrongParameter("Such an anomaly has one row.", "Use a length of 1.")
        draws.columns["r"] = [sign * (range_r[1] if extreme else draws.rng.uniform(*range_r)) for _ in draws.starts]
        return F.col("v")

    def _anomaly_type3(self, draws: Draws, is_extreme: bool = False, range_r: tuple[float, float] = (0, 10)) -> Column:
        return self._steps(draws, -1.0, range_r, is_extreme)

    def _anomaly_type4(self, draws: Draws, range_r: tuple[float, float] = (0, 10)) -> Column:
        return self._steps(draws, 1.0, range_r)

    def _shift(self, draws: Draws) -> list[tuple[int, float]]:
        return list(zip(draws.starts, draws.columns["r"])) if self.anomaly in ("type3", "type4") else []

    @staticmethod
    def _edge(draws: Draws) -> None:
        if 0 in draws.starts:
            raise WrongParameter("An anomaly begins in the first row, which has none before it.", "Use another seed.")


class PowerAnomalyGeneration(AnomalyGeneration):
    """type1: minus all before, zeros, then all at the end; type2: zeros, then the sum; type3: minus all before; type4: a share of the value before."""

    prefix_sum = True

    @staticmethod
    def _sizes(draws: Draws, test, text: str) -> None:
        if not all(test(k) for k in draws.lengths):
            raise WrongParameter(f"Such an anomaly has {text}.", "Change length_params.")

    def _anomaly_type1(self, draws: Draws, k: float = 0) -> Column:
        self._sizes(draws, lambda n: n > 2, "3 rows or more")
        first, last = -F.col("prefix") - k, F.col("prefix") + F.col("total") + k
        return F.when(F.col("k") == 0, first).when(F.col("k") == F.col("len") - 1, last).otherwise(0.0)

    def _anomaly_type2(self, draws: Draws, softstart: bool = True) -> Column:
        self._sizes(draws, lambda n: n > 1, "2 rows or more")
        if not softstart:
            return F.when(F.col("k") == F.col("len") - 1, F.col("total")).otherwise(0.0)
        draws.columns["r"] = draws.rng.rand(len(draws.starts)).tolist()
        first = F.col("r") * F.col("x0")
        return F.when(F.col("k") == 0, first).when(F.col("k") == F.col("len") - 1, F.col("total") - first).otherwise(0.0)

    def _anomaly_type3(self, draws: Draws, is_extreme: bool = False, range_r: tuple[float, float] = (0.01, 3.99), k: float = 0) -> Column:
        self._sizes(draws, lambda n: n == 1, "one row")
        draws.columns["r"] = draws.rng.uniform(*range_r, len(draws.starts)).tolist()
        return -F.col("prefix") - k if is_extreme else -F.col("r") * F.col("before")

    def _anomaly_type4(self, draws: Draws, range_r: tuple[float, float] = (0.01, 3.99)) -> Column:
        self._sizes(draws, lambda n: n == 1, "one row")
        draws.columns["r"] = draws.rng.uniform(*range_r, len(draws.starts)).tolist()
        return F.col("r") * F.col("before")


class UnusualBehaviour(AnomalyGeneration):
    """type1 and type2: lower or raise by a share of the interval's minimum; type3 and type4: the same with ramps at both ends."""

    def _by(self, draws: Draws, sign: float, lo: float, hi: float, transition: float | None = None) -> Column:
        draws.columns["r"] = [sign * draws.rng.uniform(lo, hi) for _ in draws.starts]
        change = F.col("r") * F.col("low")
        if transition is not None:
            ramp = F.floor(F.col("len") * transition)
            edge = F.least(F.col("k") + 1, F.col("len") - F.col("k"))
            change = change * F.when((ramp > 0) & (edge <= ramp), edge / (ramp + 1)).otherwise(1.0)
        return F.col("v") + change

    def _anomaly_type1(self, draws, min_factor: float = 0.3, max_factor: float = 0.8):
        return self._by(draws, -1.0, min_factor, max_factor)

    def _anomaly_type2(self, draws, min_factor: float = 0.5, max_factor: float = 1):
        return self._by(draws, 1.0, min_factor, max_factor)

    def _anomaly_type3(self, draws, min_factor: float = 0.3, max_factor: float = 0.8, transition: float = 0.1):
        return self._by(draws, -1.0, min_factor, max_factor, transition)

    def _anomaly_type4(self, draws, min_factor: float = 0.5, max_factor: float = 1, transition: float = 0.1):
        return self._by(draws, 1.0, min_factor, max_factor, transition)


@dataclass
class DriftInformation:
    """``manipulator(n)`` or a list gives what is added at ``position`` and the rows after it."""

    manipulator: object
    position: datetime
    length: int

    def drift(self) -> list[float]:
        return [float(v) for v in (self.manipulator(self.length) if callable(self.manipulator) else self.manipulator)]


class DriftInsertion(Operator):
    """Adds each drift from its position on, its last value to all later rows; drifts add up.

    A drift that ended before the series adds nothing, unless ``carry``.
    The series has one step width, that of its first two rows.
    """

    def __init__(self, drift_information: list[DriftInformation], carry: bool = False, name: str = "DriftInsertion") -> None:
        self.drift_information, self.carry, self.name = drift_information, carry, name

    def transform(self, x: Series) -> Series:
        two = [r[0] for r in x.df.select(micros(x.time).alias("t")).orderBy("t").limit(2).collect()]
        if len(two) < 2:
            return x
        step, t = two[1] - two[0], micros(x.time)
        last = x.df.agg(F.max(t)).first()[0]
        total = F.lit(0.0)
        for d in self.drift_information:
            start = x.df.sparkSession.range(1).select(F.unix_micros(F.lit(d.position).cast("timestamp"))).first()[0]
            if start > last or (start + (d.length - 1) * step < two[0] and not self.carry):
                continue
            values = F.array(*[F.lit(v) for v in d.drift()])
            k = F.floor((t - start) / step).cast("int")
            total = total + F.when(k < 0, 0.0).otherwise(F.get(values, F.least(k, F.size(values) - 1)))
        return x.with_value(F.col(x.col) + total)
