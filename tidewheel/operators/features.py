"""Calendar features, rolling statistics and rolling errors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InputNotAvailable, UtilError, WrongParameter
from ..frame import Series, align
from ..functions.holidays import holiday_table, rules
from ..functions.windows import bucketed, span_micros, time_range
from .base import Operator

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _wave(f, position: Column, period) -> Column:
    return f(F.lit(2 * math.pi) * position / period)


def calendar_columns(time: str = "time", holiday: str = "_holiday") -> dict[str, Column]:
    """Every calendar feature as an expression over the time column; months and days count from 0, Monday is 0."""
    t = F.col(time)
    wd, month, day, hour = F.weekday(t), F.month(t) - 1, F.dayofmonth(t) - 1, F.hour(t)
    days = F.dayofmonth(F.last_day(t)) + 1  # one more than the month has
    free = F.col(holiday).isNotNull()
    out = {
        "year": F.year(t), "month": month, "day": day, "weekday": wd, "hour": hour,
        "weekend": (wd >= 5).cast("int"), "workday": ((wd < 5) & ~free).cast("int"), "holiday": free.cast("int"),
    }
    for n, x, period in (("month", month, 12), ("day", day, days), ("weekday", wd, 7), ("hour", hour, 24)):
        out[f"{n}_sine"], out[f"{n}_cos"] = _wave(F.sin, x, period), _wave(F.cos, x, period)
    return out | {n: (wd == k).cast("int") for k, n in enumerate(WEEKDAYS)}


def with_holidays(df, time: str, continent: str, country: str):
    """Adds ``_holiday``, the date where it is a public holiday: a broadcast join with a few thousand dates."""
    days = holiday_table(df.sparkSession, continent, country).withColumnRenamed("holiday_date", "_holiday")
    return df.join(F.broadcast(days), F.to_date(time) == F.col("_holiday"), "left")


class CalendarExtraction(Operator):
    """Features of the time of each row; the values aren't looked at. The output has a column per feature and their array."""

    def __init__(self, continent: str = "Europe", country: str = "Germany", features: list[str] | None = None, name: str = "CalendarExtraction") -> None:
        try:
            rules(continent, country)
        except UtilError as e:
            raise WrongParameter(e.reason, e.hint) from None
        self.features = list(features or ("month", "day", "hour", "weekday"))
        if bad := [f for f in self.features if f not in KNOWN]:
            raise WrongParameter(f"Features {bad} are unknown.", f"Use some of {KNOWN}.")
        self.continent, self.country, self.name = continent, country, name

    def columns(self, x: Series):
        df = x.df.select(*x.index)
        if {"workday", "holiday"} & set(self.features):
            df = with_holidays(df, x.time, self.continent, self.country)
        else:
            df = df.withColumn("_holiday", F.lit(None).cast("date"))
        made = calendar_columns(x.time)
        return df.select(*x.index, *[made[f].alias(f) for f in self.features])

    def transform(self, x: Series) -> Series:
        out = x.on(self.columns(x))
        return out.with_value(F.array(*[F.col(f).cast("double") for f in self.features]), "calendar")


KNOWN = (
    "year", "month", "month_sine", "month_cos", "day", "day_sine", "day_cos", "hour", "hour_sine", "hour_cos",
    "weekday", "weekday_sine", "weekday_cos", *WEEKDAYS, "weekend", "workday", "holiday",
)


class RollingBase(Operator):
    """A statistic of the values in a trailing time window, of rows of the same group where one is asked for; missing gives 0.

    Series are cut into buckets of ``BUCKET`` windows, each with the rows of
    the window before it, so that one long series runs in many tasks.
    """

    BUCKET = 16

    GROUPS = ("No", "WorkdayWeekend", "WorkdayWeekendAndHoliday", "HourOnly")
    should_align = False
    min_data_in_time = True

    def __init__(self, window_size: int = 24 * 7, window_size_unit: str = "d", group_by: str = "No", continent: str = "Europe", country: str = "Germany", closed: str = "left", name: str | None = None) -> None:
        if group_by not in self.GROUPS:
            raise WrongParameter(f"group_by={group_by!r} is unknown.", f"Use one of {self.GROUPS}.")
        self.window_size, self.window_size_unit, self.group_by = window_size, window_size_unit, group_by
        self.continent, self.country, self.closed, self.name = continent, country, closed, name or type(self).__name__
        self.size = span_micros(f"{window_size}{window_size_unit}")
        time_range(self.size, closed)

    def get_min_data(self) -> int:
        return self.size

    def statistic(self, v: Column, w) -> Column:
        raise NotImplementedError

    def transform(self, x: Series, index: Series | None = None) -> Series:
        df = x.df.select(*x.index, F.col(x.col).cast("double").alias(x.col))
        if index is not None:
            df = df.join(index.df.select(*x.index), x.index, "full")
        t = F.col(x.time)
        minute, wd = F.hour(t) * 60 + F.minute(t), F.weekday(t)
        if self.group_by == "WorkdayWeekendAndHoliday":
            df = with_holidays(df, x.time, self.continent, self.country)
            group = minute + F.when((wd >= 5) | F.col("_holiday").isNotNull(), 1440).otherwise(0)
        else:
            group = {"No": F.lit(0), "HourOnly": minute, "WorkdayWeekend": minute + F.when(wd >= 5, 1440).otherwise(0)}[self.group_by]
        parts = [*x.keys, "_bucket", *([] if self.group_by == "No" else ["_group"])]
        w = time_range(self.size, self.closed, parts, x.time)
        self._time = x.time
        df = bucketed(df.withColumn("_group", group), self.size, self.BUCKET * self.size, x.time)
        value = F.coalesce(self.statistic(F.col(x.col), w), F.lit(0.0))
        df = df.select(*x.index, value.alias(x.col), "_halo").where(~F.col("_halo")).drop("_halo")
        if index is not None:
            df = df.join(index.df.select(*x.index), x.index, "left_semi")
        return x.on(df)


class RollingMean(RollingBase):
    """Mean; with ``alpha`` the last exponentially weighted mean of the window, with weights that sum to 1."""

    def __init__(self, window_size: int = 24 * 7, window_size_unit: str = "d", group_by: str = "No", continent: str = "Europe", country: str = "Germany", closed: str = "left", alpha: float | None = None, name: str | None = None) -> None:
        super().__init__(window_size, window_size_unit, group_by, continent, country, closed, name)
        self.alpha = alpha

    def statistic(self, v: Column, w) -> Column:
        if self.alpha is None:
            return F.avg(v).over(w)
        keep = F.lit(1.0 - self.alpha)
        slots = F.array_sort(F.collect_list(F.struct(F.col(self._time).alias("t"), v.alias("v"))).over(w))  # missing slots decay too
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
        step = lambda a, x: F.struct(
            (a["s"] * keep + F.coalesce(x["v"], F.lit(0.0))).alias("s"), (a["n"] * keep + F.when(x["v"].isNull(), 0.0).otherwise(1.0)).alias("n")
        )
        return F.aggregate(slots, start, step, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


class RollingVariance(RollingBase):
    def statistic(self, v: Column, w) -> Column:
        return F.var_samp(v).over(w)


class RollingSkewness(RollingBase):
    """Bias-corrected; windows without variance give 0."""

    def statistic(self, v: Column, w) -> Column:
        n = F.count(v).over(w).cast("double")
        flat = F.max(v).over(w) == F.min(v).over(w)
        return F.when(n >= 3, F.when(flat, 0.0).otherwise(F.skewness(v).over(w) * F.sqrt(n * (n - 1)) / (n - 2)))


class RollingKurtosis(RollingBase):
    """Bias-corrected excess; windows without variance give -3."""

    def statistic(self, v: Column, w) -> Column:
        n = F.count(v).over(w).cast("double")
        flat = F.max(v).over(w) == F.min(v).over(w)
        g = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v).over(w) + 6)
        return F.when(n >= 4, F.when(flat, -3.0).otherwise(g))


class RollingError(Operator):
    """An error of each prediction in a trailing window that ends with the row; y is the truth, other keywords predictions."""

    min_data_in_time = True

    def __init__(self, window_size: int = 24, window_size_unit: str = "d", name: str | None = None) -> None:
        self.window_size, self.window_size_unit, self.name = window_size, window_size_unit, name or type(self).__name__
        self.size = span_micros(f"{window_size}{window_size_unit}")

    def get_min_data(self) -> int:
        return self.size

    def row(self, d: Column, mean) -> Column:
        raise NotImplementedError

    def result(self, v: Column, w) -> Column:
        raise NotImplementedError

    def frame(self, y: Series, **predictions: Series):
        if not predictions:
            raise InputNotAvailable("No predictions are given.", "Pass them by keyword besides y.")
        df, s = align({"y": y} | predictions)
        w = time_range(self.size, "right", [*s.keys, "_bucket"], s.time)

        def errors(p: str) -> Column:
            if not y.is_array:
                return F.array(F.col(p) - F.col("y"))
            return F.zip_with(p, "y", lambda a, b: a - b)

        def mean(a: Column) -> Column:
            a = F.filter(a, lambda v: v.isNotNull())
            return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.size(a))

        rows = df.select(*s.index, *[self.row(errors(p), mean).alias(p) for p in predictions])
        rows = bucketed(rows, self.size, RollingBase.BUCKET * self.size, s.time)
        rows = rows.select(*s.index, *[self.result(F.col(p), w).alias(p) for p in predictions], "_halo")
        return s, rows.where(~F.col("_halo")).drop("_halo")

    def transform(self, y: Series, **predictions: Series) -> dict[str, Series]:
        s, out = self.frame(y, **predictions)
        return {p: s.on(out, p) for p in predictions}


class RollingMAE(RollingError):
    """Signed errors are averaged over the horizon first, so that they may cancel there."""

    def row(self, d: Column, mean) -> Column:
        return F.abs(mean(d))

    def result(self, v: Column, w) -> Column:
        return F.avg(v).over(w)


class RollingRMSE(RollingError):
    def row(self, d: Column, mean) -> Column:
        return mean(F.transform(d, lambda x: x * x))

    def result(self, v: Column, w) -> Column:
        return F.sqrt(F.avg(v).over(w))
