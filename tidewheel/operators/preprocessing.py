"""Row-local and positional operators: scaling, slices, lags, differences, resampling, interpolation, averages."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput, WrongParameter
from ..frame import Series, align
from ..functions.windows import micros, row_index, span_micros
from .base import Operator


def present(a: Column) -> Column:
    """True for arrays without a missing element."""
    return F.forall(a, lambda x: x.isNotNull())


class CustomScaler(Operator):
    has_inverse_transform = True

    def __init__(self, multiplier: float = 1.0, bias: float = 0.0, name: str = "CustomScaler") -> None:
        if multiplier == 0:
            raise WrongParameter("The multiplier is 0.", "It must not be, for the scaling couldn't be undone.")
        self.multiplier, self.bias, self.name = multiplier, bias, name

    def _map(self, x: Series, f) -> Series:
        return x.with_value(F.transform(x.col, f) if x.is_array else f(F.col(x.col)))

    def transform(self, x: Series) -> Series:
        return self._map(x, lambda v: v * F.lit(float(self.multiplier)) + F.lit(float(self.bias)))

    def inverse_transform(self, x: Series) -> Series:
        return self._map(x, lambda v: (v - F.lit(float(self.bias))) / F.lit(float(self.multiplier)))


class MissingValueDetector(Operator):
    def __init__(self, name: str = "MissingValueDetector") -> None:
        self.name = name

    def transform(self, x: Series) -> Series:
        kind = dict(x.df.dtypes)[x.col]
        v = F.col(x.col)
        return x.with_value(v.isNull() | F.coalesce(F.isnan(v), F.lit(False)) if kind in ("double", "float") else v.isNull())


class Slicer(Operator):
    """Rows ``start`` to ``end`` as Python slices count them, within each key."""

    def __init__(self, start: int | None = None, end: int | None = None, name: str = "Slicer") -> None:
        self.start, self.end, self.name = start, end, name

    def transform(self, x: Series) -> Series:
        if x.keys:
            df = x.df.withColumn("_rn", F.row_number().over(x.window) - 1)
        else:
            df = row_index(x.df, x.time, "_rn")
        bound = lambda k, n: F.lit(k) if k >= 0 else n + k
        test = F.lit(True)
        if any(k is not None and k < 0 for k in (self.start, self.end)):
            n = df.groupBy(*x.keys).agg(F.count("*").alias("_n"))
            df = df.join(n, list(x.keys)) if x.keys else df.crossJoin(F.broadcast(n))  # one row
        if self.start is not None:
            test = test & (F.col("_rn") >= bound(self.start, F.col("_n")))
        if self.end is not None:
            test = test & (F.col("_rn") < bound(self.end, F.col("_n")))
        return x.on(df.where(test).select(*x.index, x.col))


class Select(Operator):
    """Values at row offsets from each row (negative: the past); more than one offset gives an array. Rows that lack one go."""

    def __init__(self, start: int | list[int], stop: int | None = None, step: int | None = None, name: str = "Select") -> None:
        if isinstance(start, list):
            self.offsets = list(start)
        elif isinstance(start, bool) or not isinstance(start, int):
            raise WrongParameter("start is neither an int nor a list of ints.", f"It is {start!r}.")
        elif stop is None:
            self.offsets = [start]
        else:
            self.offsets = list(range(start, stop, step or 1))
        if not self.offsets:
            raise WrongParameter("Nothing is selected.", f"range({start}, {stop}, {step or 1}) is empty.")
        self.start, self.stop, self.step, self.name = start, stop, step, name

    def get_min_data(self) -> int:
        return max(0, -min(self.offsets))

    def transform(self, x: Series) -> Series:
        got = F.array(*[F.lead(x.col, i).over(x.window) for i in self.offsets])
        out = x.with_value(got)
        out = out.on(out.df.where(present(F.col(out.col))))
        return out if len(self.offsets) > 1 else out.with_value(F.element_at(F.col(out.col), 1))


class Sampler(Select):
    """The last ``sample_size`` values of each row, oldest first."""

    def __init__(self, sample_size: int, name: str = "Sampler") -> None:
        if sample_size <= 0:
            raise WrongParameter("sample_size is not positive.", f"It is {sample_size}.")
        super().__init__(list(range(-sample_size + 1, 1)), name=name)
        self.sample_size = sample_size

    def transform(self, x: Series) -> Series:
        out = super().transform(x)
        return out if self.sample_size > 1 else out.with_value(F.array(out.col))


class ClockShift(Operator):
    def __init__(self, lag: int, name: str = "ClockShift") -> None:
        self.lag, self.name = lag, name

    def get_min_data(self) -> int:
        return max(0, self.lag)

    def transform(self, x: Series) -> Series:
        out = x.with_value(F.lag(x.col, self.lag).over(x.window))
        return out.on(out.df.where(F.col(out.col).isNotNull()))


class ChangeDirection(Operator):
    """Sign of the change from the previous row; missing in the first."""

    def __init__(self, name: str = "ChangeDirection") -> None:
        self.name = name

    def transform(self, x: Series) -> Series:
        return x.with_value(F.signum(F.col(x.col) - F.lag(x.col).over(x.window)))


class Differentiate(Operator):
    """n-th differences along time (or, for arrays with axis=1, along the array).

    Not padded, the first n rows go; padded, they get ``pad_value``. With
    ``of_time`` the time column itself is differenced, in microseconds.
    """

    def __init__(self, n: int | list[int] = 1, axis: int = 0, pad: bool = False, pad_value: float = 0.0, of_time: bool = False, name: str = "Differentiate") -> None:
        if any(k < 1 for k in ([n] if isinstance(n, int) else n)):
            raise WrongParameter("n is below 1.", f"It is {n}.")
        self.n, self.axis, self.pad, self.pad_value, self.of_time, self.name = n, axis, pad, pad_value, of_time, name

    def transform(self, x: Series) -> Series | dict[str, Series]:
        if isinstance(self.n, list):
            return {f"{x.col}_d{k}": self._one(x, k) for k in self.n}
        return self._one(x, self.n)

    def _one(self, x: Series, n: int) -> Series:
        name = f"{x.col}_d{n}"
        if self.axis == 1:
            a = F.col(x.col)
            for _ in range(n):
                a = F.zip_with(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, F.lit(1), F.size(a) - 1), lambda p, q: p - q)
            if self.pad:
                a = F.concat(F.array(*[F.lit(float(self.pad_value))] * n), a)
            return x.with_value(a, name)
        v = micros(x.time) if self.of_time else F.col(x.col)
        diff = sum((F.lit((-1) ** k * comb(n, k)) * F.lag(v, k).over(x.window) for k in range(1, n + 1)), v)
        rn = F.row_number().over(x.window)
        df = x.df.select(*x.index, diff.alias(name), rn.alias("_rn"))
        if self.pad:
            df = df.withColumn(name, F.when(F.col("_rn") > n, F.col(name)).otherwise(F.lit(self.pad_value)))
        else:
            df = df.where(F.col("_rn") > n)
        return x.on(df.drop("_rn"), name)


class TrendExtraction(Operator):
    """Values 1 to ``length`` periods back; missing ones are 0."""

    def __init__(self, period: int, length: int, name: str = "TrendExtraction") -> None:
        self.period, self.length, self.name = period, length, name

    def get_min_data(self) -> int:
        return self.period * self.length

    def transform(self, x: Series) -> Series:
        if x.is_array:
            empty = F.transform(F.col(x.col), lambda _: F.lit(0.0))
            get = lambda i: F.coalesce(F.lag(x.col, i).over(x.window), empty)
        else:
            get = lambda i: F.coalesce(F.lag(x.col, i).over(x.window).cast("double"), F.lit(0.0))
        return x.with_value(F.array(*[get(self.period * i) for i in range(1, self.length + 1)]))


class Merger(Operator):
    """Forecast arrays to one value a row: mean or median over the forecasts made for it, or the k-th column."""

    def __init__(self, method: str | int = "mean", horizon: int | None = None, name: str = "Merger") -> None:
        if not isinstance(method, int) and method not in ("mean", "median"):
            raise WrongParameter(f"Method {method!r} is unknown.", "Use mean, median or an int.")
        self.method, self.horizon, self.name = method, horizon, name

    def transform(self, x: Series) -> Series:
        h = self.horizon or x.df.select(F.max(F.size(x.col))).first()[0]
        if not h:
            raise InvalidInput("There is no horizon.", "The input holds no array.")
        if isinstance(self.method, int):
            k = max(-h, min(h - 1, self.method))
            return x.with_value(F.element_at(x.col, k + 1 if k >= 0 else k))
        made = [F.lag(F.get(x.col, F.lit(i)), i).over(x.window) for i in range(h)]
        a = F.array(*made)
        if self.method == "mean":
            value = sum(made[1:], made[0]) / F.lit(float(h))
        else:
            s = F.array_sort(a)
            value = (F.get(s, F.lit((h - 1) // 2)) + F.get(s, F.lit(h // 2))) / 2
        return x.with_value(F.when(present(a), value))


class StatisticExtraction(Operator):
    """min, max, std (population) and mean over each row's array; missing elements are skipped."""

    FEATURES = ("min", "max", "std", "mean")

    def __init__(self, features: list[str] | None = None, name: str = "StatisticExtraction") -> None:
        features = list(features or self.FEATURES)
        if bad := [f for f in features if f not in self.FEATURES]:
            raise WrongParameter(f"Features {bad} are unknown.", f"Use some of {self.FEATURES}.")
        self.features, self.name = features, name

    def transform(self, x: Series) -> Series:
        a = F.filter(F.col(x.col).cast("array<double>"), lambda v: v.isNotNull())
        n = F.size(a)
        mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
        square = F.aggregate(F.transform(a, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v)
        of = {"min": F.array_min(a), "max": F.array_max(a), "mean": F.when(n > 0, mean), "std": F.when(n > 0, F.sqrt(square / n))}
        return x.with_value(F.array(*[of[f] for f in self.features]))


class Average(Operator):
    """Weighted mean of several series at each time; the weights are scaled to sum 1."""

    def __init__(self, weights: list[float] | None = None, name: str = "Average") -> None:
        self.weights, self.name = weights, name

    def transform(self, **inputs: Series) -> Series:
        return weighted_mean(inputs, self.weights or [1.0] * len(inputs))


def weighted_mean(inputs: dict[str, Series], weights: list[float]) -> Series:
    if len(weights) != len(inputs):
        raise WrongParameter(f"{len(weights)} weights for {len(inputs)} series.", "Give a weight for each.")
    df, s = align(inputs)
    total = float(sum(weights))
    used = [(n, w / total) for n, w in zip(inputs, weights)]
    if s.is_array:
        value = F.transform(F.col(used[0][0]), lambda v: v * F.lit(used[0][1]))
        for n, w in used[1:]:
            value = F.zip_with(value, F.transform(F.col(n), _times(w)), lambda a, b: a + b)
    else:
        value = sum((F.col(n) * F.lit(w) for n, w in used[1:]), F.col(used[0][0]) * F.lit(used[0][1]))
    return s.with_value(value, "average")


def _times(w: float):
    return lambda v: v * F.lit(w)


class Resampler(Operator):
    """Time bins from midnight of the first day.

    ``mean``, ``sum``, ``median``, ``min``, ``max``, ``count``, ``first`` and
    ``last`` aggregate each bin, and bins without rows are missing;
    ``interpolate`` puts a dense grid between the first and last time and
    fills it linearly; ``reduce`` takes ``func``, which maps a Column to an
    aggregate Column.
    """

    min_data_in_time = True
    AGGREGATES = ("mean", "sum", "median", "min", "max", "count", "first", "last")

    def __init__(self, target_time: str = "1h", method: str = "mean", func=None, name: str = "Resampler") -> None:
        if method not in (*self.AGGREGATES, "interpolate", "reduce"):
            raise WrongParameter(f"Method {method!r} is unknown.", f"Use one of {self.AGGREGATES}, interpolate or reduce.")
        self.target_time, self.method, self.func, self.name = target_time, method, func, name
        self.width = span_micros(target_time)

    def get_min_data(self) -> int:
        return self.width

    def transform(self, x: Series) -> Series:
        kind = dict(x.df.dtypes)[x.time]
        stamp = lambda us: F.timestamp_micros(us).cast(kind)
        width, us = F.lit(self.width), micros(x.time)
        ends = x.df.groupBy(*x.keys).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
        day = F.lit(86_400_000_000)
        ends = ends.withColumn("_t0", F.floor(F.col("_lo") / day) * day if self.method != "interpolate" else F.col("_lo"))
        to_bin = lambda u: F.col("_t0") + F.floor((u - F.col("_t0")) / width) * width
        grid = ends.select(*x.keys, F.explode(F.sequence(to_bin(F.col("_lo")), to_bin(F.col("_hi")), width)).alias("_us"))
        with_ends = x.df.join(F.broadcast(ends) if not x.keys else ends, list(x.keys)) if x.keys else x.df.crossJoin(F.broadcast(ends))
        if self.method == "interpolate":
            own = x.df.select(*x.keys, us.alias("_us"), F.col(x.col).cast("double").alias(x.col), F.lit(False).alias("_grid"))
            both = own.unionByName(grid.select(*x.keys, "_us", F.lit(None).cast("double").alias(x.col), F.lit(True).alias("_grid")))
            both = both.groupBy(*x.keys, "_us").agg(F.max(x.col).alias(x.col), F.max("_grid").alias("_grid"))  # times are unique in a series
            both = both.withColumn(x.time, stamp(F.col("_us")))
            filled = LinearInterpolater(fill_value=None).columns(Series(both, x.col, x.time, x.keys), "_grid")
            return x.on(filled.where("_grid").select(*x.index, x.col))
        agg = self.func(F.col(x.col)) if self.method == "reduce" else getattr(F, self.method)(x.col)
        if self.method in ("first", "last"):
            pick = F.min_by if self.method == "first" else F.max_by
            agg = pick(x.col, x.time)
        bins = with_ends.groupBy(*x.keys, to_bin(us).alias("_us")).agg(agg.alias(x.col))
        out = grid.join(bins, [*x.keys, "_us"], "left")
        return x.on(out.select(*x.keys, stamp(F.col("_us")).alias(x.time), x.col))


class LinearInterpolater(Operator):
    """Missing values from the nearest valid ones in time.

    ``linear`` extrapolates both ends from the two nearest valid points (with
    one valid point they stay missing); ``nearest`` takes the nearer one, the
    earlier on ties; ``zero`` and ``previous`` the last one before, ``next`` the
    first one after. ``fill_value`` other than
    ``extrapolate`` leaves the ends missing.
    """

    def __init__(self, method: str = "linear", fill_value: str | None = "extrapolate", name: str = "LinearInterpolater") -> None:
        if method not in ("linear", "slinear", "nearest", "zero", "previous", "next"):
            raise WrongParameter(f"Method {method!r} is unknown.", "Use linear, slinear, nearest, zero, previous or next.")
        self.method, self.fill_value, self.name = method, fill_value, name

    def transform(self, x: Series) -> Series:
        return x.on(self.columns(x))

    def columns(self, x: Series, *others: str):
        """The filled column, and others as they are; points at the ends are sought only where they are needed."""
        us, v = micros(x.time), F.col(x.col).cast("double")
        ends = self.fill_value == "extrapolate"
        point = F.when(v.isNotNull(), F.struct(us.alias("t"), v.alias("v")))
        back = x.window.rowsBetween(Window.unboundedPreceding, 0)
        falling = Window.partitionBy(*x.keys).orderBy(F.col(x.time).desc())
        ahead = falling.rowsBetween(Window.unboundedPreceding, 0)  # frames that end at the last row cost a pass a row
        everything = x.window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        down = falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = x.df.select(
            *x.index, *others, v.alias("_v"), us.alias("_t"),
            F.last(point, True).over(back).alias("_p"), F.last(point, True).over(ahead).alias("_n"),
            *[F.nth_value(point, k, True).over(everything).alias(f"_a{k}") for k in (1, 2) if ends and "linear" in self.method],
            *[F.nth_value(point, k, True).over(down).alias(f"_z{k}") for k in (1, 2) if ends and "linear" in self.method],
        )

        def line(a: str, b: str) -> Column:
            return F.col(f"{a}.v") + (F.col("_t") - F.col(f"{a}.t")) * (F.col(f"{b}.v") - F.col(f"{a}.v")) / (F.col(f"{b}.t") - F.col(f"{a}.t"))

        if self.method == "nearest":
            inner = F.when(F.col("_t") - F.col("_p.t") <= F.col("_n.t") - F.col("_t"), F.col("_p.v")).otherwise(F.col("_n.v"))
            head, tail = F.col("_n.v"), F.col("_p.v")
        elif self.method in ("zero", "previous"):
            inner, head, tail = F.col("_p.v"), F.col("_n.v"), F.col("_p.v")
        elif self.method == "next":
            inner, head, tail = F.col("_n.v"), F.col("_n.v"), F.col("_p.v")
        else:
            inner = line("_p", "_n")
            head, tail = (line("_a1", "_a2"), line("_z2", "_z1")) if ends else (None, None)
        lost = F.lit(None).cast("double")
        value = (
            F.when(F.col("_v").isNotNull(), F.col("_v"))
            .when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), inner)
            .when(F.col("_p").isNull(), head if ends else lost)
            .otherwise(tail if ends else lost)
        )
        return df.select(*x.index, value.alias(x.col), *others)


def either(first: Series, *others: Series) -> Series:
    """The first input that has a value at each time."""
    df, s = align({f"_{k}": x for k, x in enumerate((first, *others))}, "full")
    return s.with_value(F.coalesce(*[F.col(f"_{k}") for k in range(len(others) + 1)]), first.col)


def clean_training_rows(df, hist: str = "hist_input", y: str = "y", others: tuple[str, ...] = (), run: int = 2):
    """Keep rows without missing elements, without a 0 in y, and without ``run`` + 3 equal values in a row in hist or y."""

    def runs_ok(c: str) -> Column:
        start = F.struct(F.lit(-1.0).alias("last"), F.lit(0).alias("n"), F.lit(True).alias("ok"))
        step = lambda s, v: F.struct(
            v.alias("last"),
            F.when(v == s["last"], s["n"] + 1).otherwise(F.lit(0)).alias("n"),
            (s["ok"] & ~((v == s["last"]) & (s["n"] + 1 > run + 1))).alias("ok"),
        )
        return F.aggregate(F.col(c).cast("array<double>"), start, step, lambda s: s["ok"])

    test = ~F.exists(F.col(y), lambda v: v == 0) & runs_ok(hist) & runs_ok(y)
    for c in (hist, y, *others):
        test = test & present(F.col(c))
    return df.where(test)
