"""Registered queries of the time-series operators over the driver's tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Series, ingest
from ..functions.holidays import holidays
from ..operators import features, generation, metrics, models, networks, preprocessing
from ..sources.tables import split_rows
from ..streaming.online import batch_rmse, windowed
from .pipeline import Mode, Pipeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Amounts are divided by a prime, so that no result lies on a rounding tie.
_DAILY = "daily AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS time, sum(o_totalprice) / 7919.0 AS v FROM orders GROUP BY 1)"
_SEG = (
    "seg AS (SELECT c_mktsegment AS k, date_trunc('day', o_orderdate)::TIMESTAMP AS time, sum(o_totalprice) / 7919.0 AS v, count(*)::DOUBLE AS n, avg(o_totalprice) / 7919.0 AS a"
    " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
)
_EV = "ev AS (SELECT event_type AS k, ts::TIMESTAMP AS time, event_id AS id, value / 7.919 AS v FROM events)"
_W = "(PARTITION BY k ORDER BY time)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = "WITH " + ", ".join((_DAILY, _SEG, _EV)) + (sql if sql.startswith(",") else " " + sql)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ingest(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _day(c: str):
    return F.date_trunc("day", F.col(c).cast("timestamp")).cast("timestamp_ntz")


def daily(spark, d) -> Series:
    """Revenue by day."""
    df = _table(spark, d, "orders").groupBy(_day("o_orderdate").alias("time")).agg((F.sum("o_totalprice") / 7919.0).alias("v"))
    return Series(df, "v")


def segments(spark, d, col: str = "v") -> Series:
    """Revenue, orders and mean price by market segment and day."""
    o, c = _table(spark, d, "orders"), _table(spark, d, "customer")
    df = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("k"), _day("o_orderdate").alias("time"))
    df = df.agg((F.sum("o_totalprice") / 7919.0).alias("v"), F.count("*").cast("double").alias("n"), (F.avg("o_totalprice") / 7919.0).alias("a"))
    return Series(df, col, keys=("k",))


def events(spark, d) -> Series:
    """Values by event type, unevenly spaced."""
    df = _table(spark, d, "events").select(F.col("event_type").alias("k"), F.col("ts").cast("timestamp_ntz").alias("time"), F.col("event_id").alias("id"), (F.col("value") / 7.919).alias("v"))
    return Series(df, "v", keys=("k",))


def out(s: Series, digits: int = 4, name: str = "v") -> DataFrame:
    kind = dict(s.df.dtypes)[s.col]
    v = F.col(s.col)
    if kind == "array<double>":
        v = F.concat_ws(",", F.transform(v, lambda x: F.coalesce(F.round(x, digits).cast("decimal(38,4)").cast("string"), F.lit("null"))))
    elif kind == "double":
        v = F.round(v, digits) + 0.0  # no negative zero
    return s.df.select(*s.index, v.alias(name))


def arr(items: str) -> str:
    """SQL for an array of doubles as text with 4 decimals."""
    return f"array_to_string(list_transform([{items}], lambda x: coalesce(round(x, 4)::DECIMAL(38,4)::VARCHAR, 'null')), ',')"


@query("flagship_revenue_rolling_mean", """SELECT time, round(coalesce(avg(v) OVER (ORDER BY time RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0), 4) AS v FROM daily""")
def flagship(spark, d):
    return out(features.RollingMean(7, "d").transform(daily(spark, d)))


@query("custom_scale", f"SELECT k, time, round(v * 2.0 + 5.0, 4) AS v FROM seg")
def _(spark, d):
    return out(preprocessing.CustomScaler(2.0, 5.0).transform(segments(spark, d)))


@query("inverse_scale", f"SELECT k, time, round((v - 5.0) / 2.0, 4) AS v FROM seg")
def _(spark, d):
    return out(preprocessing.CustomScaler(2.0, 5.0).inverse_transform(segments(spark, d)))


@query("missing_mask", "SELECT k, time, id, v IS NULL AS v FROM (SELECT k, time, id, CASE WHEN id % 7 = 0 THEN NULL ELSE v END AS v FROM ev)")
def _(spark, d):
    e = events(spark, d)
    df = e.df.withColumn("v", F.when(F.col("id") % 7 != 0, F.col("v")))
    s = Series(df, "v", keys=("k", "id"))
    return out(preprocessing.MissingValueDetector().transform(s))


for _name, _a, _b, _test in (("slice_rows_pos", 3, 50, "rn >= 3 AND rn < 50"), ("slice_rows_neg", -20, -5, "rn >= cnt - 20 AND rn < cnt - 5")):

    @query(_name, f"SELECT k, time, round(v, 4) AS v FROM (SELECT *, row_number() OVER {_W} - 1 AS rn, count(*) OVER (PARTITION BY k) AS cnt FROM seg) WHERE {_test}")
    def _(spark, d, a=_a, b=_b):
        return out(preprocessing.Slicer(a, b).transform(segments(spark, d)))


@query("slice_rows_unkeyed", "SELECT time, round(v, 4) AS v FROM (SELECT *, row_number() OVER (ORDER BY time) - 1 AS rn FROM daily) WHERE rn >= 100 AND rn < 900")
def _(spark, d):
    return out(preprocessing.Slicer(100, 900).transform(daily(spark, d)))


@query("select_lags", f"SELECT k, time, {arr('a, b, c')} AS v FROM (SELECT k, time, lag(v, 2) OVER {_W} AS a, lag(v, 1) OVER {_W} AS b, v AS c FROM seg) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def _(spark, d):
    return out(preprocessing.Select(-2, 1, 1).transform(segments(spark, d)))


@query("select_list", f"SELECT k, time, {arr('a, b')} AS v FROM (SELECT k, time, lead(v, 2) OVER {_W} AS a, lead(v, 5) OVER {_W} AS b FROM seg) WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    return out(preprocessing.Select([2, 5]).transform(segments(spark, d)))


@query("sampler", f"SELECT k, time, {arr('a, b, c')} AS v FROM (SELECT k, time, lag(v, 2) OVER {_W} AS a, lag(v, 1) OVER {_W} AS b, v AS c FROM seg) WHERE a IS NOT NULL")
def _(spark, d):
    return out(preprocessing.Sampler(3).transform(segments(spark, d)))


@query("clock_shift", f"SELECT k, time, round(a, 4) AS v FROM (SELECT k, time, lag(v, 3) OVER {_W} AS a FROM seg) WHERE a IS NOT NULL")
def _(spark, d):
    return out(preprocessing.ClockShift(3).transform(segments(spark, d)))


@query("change_direction", f"SELECT k, time, sign(v - lag(v) OVER {_W})::DOUBLE AS v FROM seg")
def _(spark, d):
    return out(preprocessing.ChangeDirection().transform(segments(spark, d)))


@query("diff_n1", f"SELECT k, time, round(a, 4) AS v FROM (SELECT k, time, v - lag(v) OVER {_W} AS a, row_number() OVER {_W} AS rn FROM seg) WHERE rn > 1")
def _(spark, d):
    return out(preprocessing.Differentiate(1).transform(segments(spark, d)))


@query("diff_n2_pad", f"SELECT k, time, round(CASE WHEN rn > 2 THEN a ELSE 0 END, 4) AS v FROM (SELECT k, time, v - 2 * lag(v) OVER {_W} + lag(v, 2) OVER {_W} AS a, row_number() OVER {_W} AS rn FROM seg)")
def _(spark, d):
    return out(preprocessing.Differentiate(2, pad=True).transform(segments(spark, d)))


@query("trend_lags", f"SELECT k, time, {arr('a, b, c')} AS v FROM (SELECT k, time, lag(v, 7, 0.0) OVER {_W} AS a, lag(v, 14, 0.0) OVER {_W} AS b, lag(v, 21, 0.0) OVER {_W} AS c FROM seg)")
def _(spark, d):
    return out(preprocessing.TrendExtraction(7, 3).transform(segments(spark, d)))


def _horizon(spark, d) -> Series:
    return preprocessing.Select([0, 1, 2]).transform(segments(spark, d))


_H = f"hz AS (SELECT * FROM (SELECT k, time, v AS x0, lead(v, 1) OVER {_W} AS x1, lead(v, 2) OVER {_W} AS x2 FROM seg) WHERE x2 IS NOT NULL)"
_M = f"SELECT k, time, x0 AS a, lag(x1, 1) OVER {_W} AS b, lag(x2, 2) OVER {_W} AS c FROM hz"
for _name, _method, _expr in (
    ("merge_mean", "mean", "(a + b + c) / 3"),
    ("merge_median", "median", "CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN list_sort([a, b, c])[2] END"),
):

    @query(_name, f", {_H} SELECT k, time, round({_expr}, 4) AS v FROM ({_M})")
    def _(spark, d, m=_method):
        return out(preprocessing.Merger(m, horizon=3).transform(_horizon(spark, d)))


@query("merge_k", f", {_H} SELECT k, time, round(x2, 4) AS v FROM hz")
def _(spark, d):
    return out(preprocessing.Merger(-1, horizon=3).transform(_horizon(spark, d)))


@query("stats_horizon", f""", {_H} SELECT k, time, {arr('least(x0, x1, x2), greatest(x0, x1, x2), sqrt(((x0 - m) ** 2 + (x1 - m) ** 2 + (x2 - m) ** 2) / 3), m')} AS v FROM (SELECT *, (x0 + x1 + x2) / 3 AS m FROM hz)""")
def _(spark, d):
    return out(preprocessing.StatisticExtraction().transform(_horizon(spark, d)))


_WD = "(isodow(time) - 1)"
_DAYS = "(day(last_day(time)) + 1)"
_CAL = {
    "calendar_basic": (["year", "month", "day", "weekday", "hour"], ["year(time)", "month(time) - 1", "day(time) - 1", _WD, "hour(time)"]),
    "calendar_flags": ([*features.WEEKDAYS, "weekend"], [*(f"CASE WHEN {_WD} = {k} THEN 1 ELSE 0 END" for k in range(7)), f"CASE WHEN {_WD} >= 5 THEN 1 ELSE 0 END"]),
    "calendar_cyclic": (
        [f"{n}_{f}" for n in ("month", "day", "weekday", "hour") for f in ("sine", "cos")],
        [f"{f}(2 * pi() * {x} / {p})" for x, p in (("(month(time) - 1)", "12"), ("(day(time) - 1)", _DAYS), (_WD, "7"), ("hour(time)", "24")) for f in ("sin", "cos")],
    ),
}
for _name, (_features, _exprs) in _CAL.items():
    _cast = "::DOUBLE, 6) + 0.0" if _name == "calendar_cyclic" else "::INTEGER"
    _cols = ", ".join(f"{'round(' if '6)' in _cast else ''}({e}){_cast} AS {f}" for f, e in zip(_features, _exprs))

    @query(_name, f"SELECT k, time, id, {_cols} FROM ev")
    def _(spark, d, fs=_features):
        e = events(spark, d)
        df = features.CalendarExtraction(features=fs).columns(Series(e.df, "v", keys=("k", "id")))
        return df.select("k", "time", "id", *[(F.round(f, 6) + 0.0).alias(f) if f[-4:] in ("sine", "_cos") else F.col(f).cast("int").alias(f) for f in fs])


_HOL = ", ".join(f"DATE '{h}'" for h in holidays("Europe", "Germany", 1994, 2002))


@query("calendar_holiday", f"SELECT time, (time::DATE IN ({_HOL}))::INTEGER AS holiday, ({_WD} < 5 AND time::DATE NOT IN ({_HOL}))::INTEGER AS workday FROM daily")
def _(spark, d):
    return features.CalendarExtraction(features=["holiday", "workday"]).columns(daily(spark, d))


_RANGES = {
    "left": "INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING",
    "right": "INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW",
    "both": "INTERVAL 7 DAY PRECEDING AND CURRENT ROW",
    "neither": "INTERVAL '6 days 23:59:59.999999' PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING",
}
_KINDS = {
    "mean": (features.RollingMean, "avg(v) OVER w"),
    "var": (features.RollingVariance, "CASE WHEN count(v) OVER w >= 2 THEN var_samp(v) OVER w END"),
    "skew": (features.RollingSkewness, "CASE WHEN count(v) OVER w >= 3 THEN CASE WHEN max(v) OVER w = min(v) OVER w THEN 0 ELSE skewness(v) OVER w END END"),
    "kurt": (features.RollingKurtosis, "CASE WHEN count(v) OVER w >= 4 THEN CASE WHEN max(v) OVER w = min(v) OVER w THEN -3 ELSE kurtosis(v) OVER w END END"),
}
for _kind, (_cls, _expr) in _KINDS.items():
    for _closed, _range in _RANGES.items():

        @query(f"rolling_{_kind}_{_closed}", f"SELECT k, time, round(coalesce({_expr}, 0), 4) + 0.0 AS v FROM (SELECT k, time, a AS v FROM seg) WINDOW w AS (PARTITION BY k ORDER BY time RANGE BETWEEN {_range})")
        def _(spark, d, cls=_cls, closed=_closed):
            return out(cls(7, "d", closed=closed).transform(segments(spark, d, "a")))


@query("rolling_mean_ewm", f"""SELECT k, time, round(coalesce(sum(b.v * pow(0.5, b.back)) / sum(pow(0.5, b.back)), 0), 4) AS v FROM (
SELECT x.k, x.time, y.v, row_number() OVER (PARTITION BY x.k, x.time ORDER BY y.time DESC) - 1 AS back FROM seg x LEFT JOIN seg y ON x.k = y.k AND y.time < x.time AND y.time >= x.time - INTERVAL 7 DAY) b GROUP BY k, time""")
def _(spark, d):
    return out(features.RollingMean(7, "d", alpha=0.5).transform(segments(spark, d)))


for _name, _group, _expr in (
    ("rolling_by_workday_weekend", "WorkdayWeekend", f"hour(time) * 60 + minute(time) + CASE WHEN {_WD} >= 5 THEN 1440 ELSE 0 END"),
    ("rolling_by_hour", "HourOnly", "hour(time) * 60 + minute(time)"),
    ("rolling_by_holiday", "WorkdayWeekendAndHoliday", f"hour(time) * 60 + minute(time) + CASE WHEN {_WD} >= 5 OR time::DATE IN ({_HOL}) THEN 1440 ELSE 0 END"),
):

    @query(_name, f"SELECT k, time, round(coalesce(avg(v) OVER (PARTITION BY k, g ORDER BY time RANGE BETWEEN {_RANGES['left']}), 0), 4) AS v FROM (SELECT *, {_expr} AS g FROM seg)")
    def _(spark, d, g=_group):
        return out(features.RollingMean(7, "d", group_by=g).transform(segments(spark, d)))


for _name, _cls, _row, _res in (("rolling_mae", features.RollingMAE, "abs(p - v)", "avg(e) OVER w"), ("rolling_rmse", features.RollingRMSE, "(p - v) ** 2", "sqrt(avg(e) OVER w)")):

    @query(_name, f"SELECT k, time, round({_res}, 4) AS v FROM (SELECT k, time, {_row} AS e FROM (SELECT *, lag(v) OVER {_W} AS p FROM seg)) WINDOW w AS (PARTITION BY k ORDER BY time RANGE BETWEEN INTERVAL '9 days 23:59:59.999999' PRECEDING AND CURRENT ROW)")
    def _(spark, d, cls=_cls):
        y = segments(spark, d)
        df = y.df.withColumn("p", F.lag("v").over(y.window))
        return out(cls(10, "d").transform(y.on(df), p=y.on(df, "p"))["p"])


for _m in ("mean", "sum", "median", "min", "max"):
    _f = {"mean": "avg"}.get(_m, _m)

    @query(f"resample_{_m}", f""", b AS (SELECT k, min(time) AS lo, max(time) AS hi FROM ev GROUP BY k),
g AS (SELECT k, date_trunc('day', lo) AS t0, unnest(generate_series(0::BIGINT, ((epoch_us(hi) - epoch_us(date_trunc('day', lo))) // 21600000000)::BIGINT)) AS i, lo FROM b),
x AS (SELECT ev.k, (epoch_us(time) - epoch_us(date_trunc('day', lo))) // 21600000000 AS i, {_f}(v) AS v FROM ev JOIN b USING (k) GROUP BY 1, 2)
SELECT g.k, make_timestamp(epoch_us(t0) + g.i * 21600000000) AS time, round(v, 4) AS v FROM g LEFT JOIN x ON g.k = x.k AND g.i = x.i WHERE g.i >= (epoch_us(lo) - epoch_us(t0)) // 21600000000""")
    def _(spark, d, m=_m):
        return out(preprocessing.Resampler("6h", m).transform(events(spark, d)))


_GAPS = "gaps AS (SELECT k, time, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY time) % 5 IN (0, 1) THEN NULL ELSE v END AS v FROM seg)"
_NEAR = """p AS (SELECT *, epoch_us(time)::DOUBLE AS t, CASE WHEN v IS NOT NULL THEN {'t': epoch_us(time)::DOUBLE, 'v': v} END AS s FROM gaps),
q AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY k ORDER BY time ROWS UNBOUNDED PRECEDING) AS b,
first_value(s IGNORE NULLS) OVER (PARTITION BY k ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM p),
e AS (SELECT k, list({'t': t, 'v': v} ORDER BY time) AS l FROM p WHERE v IS NOT NULL GROUP BY k)"""


def _gaps(spark, d) -> Series:
    s = segments(spark, d)
    return s.on(s.df.select("k", "time", F.when(~(F.row_number().over(s.window) % 5).isin(0, 1), F.col("v")).alias("v")))


@query("interpolate_linear", f""", {_GAPS}, {_NEAR} SELECT k, time, round(CASE WHEN v IS NOT NULL THEN v
WHEN b IS NOT NULL AND n IS NOT NULL THEN b.v + (t - b.t) * (n.v - b.v) / (n.t - b.t)
WHEN b IS NULL THEN l[1].v + (t - l[1].t) * (l[2].v - l[1].v) / (l[2].t - l[1].t)
ELSE l[-2].v + (t - l[-2].t) * (l[-1].v - l[-2].v) / (l[-1].t - l[-2].t) END, 4) AS v FROM q JOIN e USING (k)""")
def _(spark, d):
    return out(preprocessing.LinearInterpolater().transform(_gaps(spark, d)))


@query("interpolate_nearest", f""", {_GAPS}, {_NEAR} SELECT k, time, round(CASE WHEN v IS NOT NULL THEN v WHEN b IS NULL THEN n.v WHEN n IS NULL THEN b.v
WHEN t - b.t <= n.t - t THEN b.v ELSE n.v END, 4) AS v FROM q""")
def _(spark, d):
    return out(preprocessing.LinearInterpolater("nearest").transform(_gaps(spark, d)))


@query("upsample_linear", f""", b AS (SELECT k, min(time) AS lo, max(time) AS hi FROM seg GROUP BY k),
g AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 12 HOUR)) AS time FROM b),
j AS (SELECT g.k, g.time, epoch_us(g.time)::DOUBLE AS t, v, CASE WHEN v IS NOT NULL THEN {{'t': epoch_us(g.time)::DOUBLE, 'v': v}} END AS s FROM g LEFT JOIN seg ON g.k = seg.k AND g.time = seg.time),
q AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY k ORDER BY time ROWS UNBOUNDED PRECEDING) AS b,
first_value(s IGNORE NULLS) OVER (PARTITION BY k ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM j)
SELECT k, time, round(coalesce(v, b.v + (t - b.t) * (n.v - b.v) / (n.t - b.t)), 4) AS v FROM q""")
def _(spark, d):
    return out(preprocessing.Resampler("12h", "interpolate").transform(segments(spark, d)))


@query("average", "SELECT k, time, round((v + n) / 2, 4) AS v FROM seg")
def _(spark, d):
    s = segments(spark, d)
    return out(preprocessing.Average().transform(a=s, b=s.on(s.df, "n")))


@query("average_weighted", "SELECT k, time, round(v * 0.75 + n * 0.25, 4) AS v FROM seg")
def _(spark, d):
    s = segments(spark, d)
    return out(preprocessing.Average([3.0, 1.0]).transform(a=s, b=s.on(s.df, "n")))


_FC = f"fc AS (SELECT * FROM (SELECT k, time, v, lag(v, 1) OVER {_W} AS p1, lag(v, 7) OVER {_W} AS p2, (lag(v, 1) OVER {_W} + lag(v, 2) OVER {_W}) / 2 AS p3 FROM seg) WHERE p2 IS NOT NULL)"


def _forecasts(spark, d) -> dict[str, Series]:
    s = segments(spark, d)
    back = lambda k: F.lag("v", k).over(s.window)
    df = s.df.select("k", "time", "v", back(1).alias("p1"), back(7).alias("p2"), ((back(1) + back(2)) / 2).alias("p3")).where("p2 is not null")
    return {c: s.on(df, c) for c in ("v", "p1", "p2", "p3")}


_LOSS = "ls AS (SELECT " + ", ".join(f"sqrt(avg((p{i} - v) ** 2)) AS l{i}" for i in (1, 2, 3)) + " FROM fc)"


@query("ensemble_auto", f", {_FC}, {_LOSS} SELECT k, time, round((p1 / l1 + p2 / l2 + p3 / l3) / (1 / l1 + 1 / l2 + 1 / l3), 2) AS v FROM fc, ls")
def _(spark, d):
    f = _forecasts(spark, d)
    target = f.pop("v")
    return out(metrics.Ensemble(weights="auto").fit(target=target, **f).transform(**f), 2)


@query("ensemble_kbest", f""", {_FC}, {_LOSS}, w AS (SELECT (l1 < greatest(l1, l2, l3))::INT AS w1, (l2 < greatest(l1, l2, l3))::INT AS w2, (l3 < greatest(l1, l2, l3))::INT AS w3 FROM ls)
SELECT k, time, round((p1 * w1 + p2 * w2 + p3 * w3) / (w1 + w2 + w3), 4) AS v FROM fc, w""")
def _(spark, d):
    f = _forecasts(spark, d)
    target = f.pop("v")
    return out(metrics.Ensemble(k_best=2).fit(target=target, **f).transform(**f))


_CUT = (datetime(1996, 1, 1), datetime(1997, 6, 30))
_CUTSQL = "time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'"
_ERR = {
    "MAE": (metrics.MAE, "avg(abs(p - v))"),
    "RMSE": (metrics.RMSE, "sqrt(avg((p - v) ** 2))"),
    "MAPE": (metrics.MAPE, "100 * avg(CASE WHEN v <> 0 THEN abs((p - v) / v) END)"),
    "MaxErr": (metrics.MaxErr, "max(abs(p - v))"),
    "MinErr": (metrics.MinErr, "min(abs(p - v))"),
}
_LONG = "lg AS (SELECT k, time, v, 'p1' AS key, p1 AS p FROM fc UNION ALL SELECT k, time, v, 'p2', p2 FROM fc)"


def _errors(spark, d, **options) -> DataFrame:
    f = _forecasts(spark, d)
    all_ = metrics.evaluate([cls(**options) for cls, _ in _ERR.values()], f["v"], p1=f["p1"], p2=f["p2"])
    return all_.select("summary", "key", F.round("value", 4).alias("value"))


def _err_sql(where: str = "TRUE", suffix: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS summary, key || '{suffix}' AS key, round({e}, 4) AS value FROM lg WHERE {where} GROUP BY key" for n, (_, e) in _ERR.items())


@query("metric_all", f", {_FC}, {_LONG} {_err_sql()}")
def _(spark, d):
    return _errors(spark, d)


@query("metric_cuts", f", {_FC}, {_LONG} {_err_sql()} UNION ALL {_err_sql(_CUTSQL, ': Cut from 1996-01-01 00:00:00 to 1997-06-30 00:00:00')}")
def _(spark, d):
    return _errors(spark, d, cuts=[_CUT])


@query("metric_offset", f", {_FC}, {_LONG.replace('FROM fc', f'FROM (SELECT * FROM (SELECT *, row_number() OVER {_W} AS rn FROM fc) WHERE rn > 30)')} {_err_sql()}")
def _(spark, d):
    return _errors(spark, d, offset=30)


@query("metric_mase", f", {_FC}, m AS (SELECT *, lag(v, 7) OVER {_W} AS b FROM fc) SELECT 'MASE' AS summary, 'p1' AS key, round(avg(abs(p1 - v)) / avg(abs(v - b)), 4) AS value FROM m WHERE b IS NOT NULL")
def _(spark, d):
    f = _forecasts(spark, d)
    return metrics.MASE(lag=7).transform(f["v"], p1=f["p1"]).select("summary", "key", F.round("value", 4).alias("value"))


_CLS = "cl AS (SELECT doc_id, quality AS t, (doc_id % 3 > 0)::INT AS p FROM labels)"


def _classes(spark, d) -> tuple[Series, Series]:
    df = _table(spark, d, "labels").select("doc_id", F.col("quality").alias("t"), (F.col("doc_id") % 3 > 0).cast("int").alias("p"))
    return Series(df, "t", time="doc_id"), Series(df, "p", time="doc_id")


@query("f1_micro", f", {_CLS} SELECT 'F1Score' AS summary, 'p' AS key, round(avg((p = t)::INT), 6) AS value FROM cl")
def _(spark, d):
    t, p = _classes(spark, d)
    return metrics.F1Score().transform(t, p=p).select("summary", "key", F.round("value", 6).alias("value"))


@query("f1_macro", f""", {_CLS}, c AS (SELECT DISTINCT t AS c FROM cl UNION SELECT DISTINCT p FROM cl)
SELECT 'F1Score' AS summary, 'p' AS key, round(avg(f), 6) AS value FROM (SELECT c, 2.0 * count(*) FILTER (t = c AND p = c) / (count(*) FILTER (t = c) + count(*) FILTER (p = c)) AS f FROM cl, c GROUP BY c)""")
def _(spark, d):
    t, p = _classes(spark, d)
    return metrics.F1Score("macro").transform(t, p=p).select("summary", "key", F.round("value", 6).alias("value"))


@query("confusion_matrix", f""", {_CLS}, c AS (SELECT DISTINCT t AS c FROM cl UNION SELECT DISTINCT p FROM cl)
SELECT 'p' AS prediction, a.c AS gt, b.c AS pred, (SELECT count(*) FROM cl WHERE t = a.c AND p = b.c) AS n FROM c a, c b""")
def _(spark, d):
    t, p = _classes(spark, d)
    return metrics.ConfusionMatrix().transform(t, p=p)


@query("standard_scale", "SELECT k, time, round((v - (SELECT avg(v) FROM seg)) / (SELECT stddev_pop(v) FROM seg), 4) AS v FROM seg")
def _(spark, d):
    s = segments(spark, d)
    return out(models.StandardScaler().fit(s).transform(s))


@query("kbest_f", f", {_FC} SELECT k, time, {arr('CASE WHEN abs(c1) >= abs(c2) THEN p1 ELSE p2 END')} AS v FROM fc, (SELECT corr(p1, v) AS c1, corr(p2, v) AS c2 FROM fc)")
def _(spark, d):
    f = _forecasts(spark, d)
    return out(models.SelectKBest(1).fit(target=f["v"], p1=f["p1"], p2=f["p2"]).transform(p1=f["p1"], p2=f["p2"]))


@query("linreg_predict", f", {_FC} SELECT k, time, round(i + s * p1, 2) AS v FROM fc, (SELECT regr_intercept(v, p1) AS i, regr_slope(v, p1) AS s FROM fc)")
def _(spark, d):
    f = _forecasts(spark, d)
    return out(models.LinearRegression().fit(target=f["v"], p1=f["p1"]).transform(p1=f["p1"]), 2)


@query("either_or_coalesce", f", {_GAPS} SELECT k, time, round(coalesce(gaps.v, seg.a), 4) AS v FROM gaps JOIN seg USING (k, time)")
def _(spark, d):
    s, g = segments(spark, d), _gaps(spark, d)
    return out(preprocessing.either(g, s.on(s.df, "a")))


@query("conditional_route", "SELECT k, time, round(CASE WHEN isodow(time) >= 6 THEN v * 2.0 ELSE v + 1.0 END, 4) AS v FROM seg")
def _(spark, d):
    s = segments(spark, d)
    a, b = preprocessing.CustomScaler(2.0).transform(s), preprocessing.CustomScaler(bias=1.0).transform(s)
    weekend = F.weekday("time") >= 5
    return out(preprocessing.either(a.on(a.df.where(weekend)), b.on(b.df.where(~weekend))))


@query("drift_insert", """SELECT time, round(v + CASE WHEN time < TIMESTAMP '1996-03-01' THEN 0 ELSE [10.0, 20.0, 30.0][least(3, ((epoch_us(time) - epoch_us(TIMESTAMP '1996-03-01')) // step)::INT + 1)] END, 4) AS v
FROM daily, (SELECT epoch_us(max(time)) - epoch_us(min(time)) AS step FROM (SELECT time FROM daily ORDER BY time LIMIT 2))""")
def _(spark, d):
    drift = generation.DriftInformation([10.0, 20.0, 30.0], datetime(1996, 3, 1), 3)
    return out(generation.DriftInsertion([drift]).transform(daily(spark, d)))


#: Places (first row, rows) of the generated anomalies, and the SQL of what they need.
_LONG_PLACES, _SHORT_PLACES = [(40, 5), (300, 3), (700, 6)], [(40, 1), (300, 1), (700, 1)]


def _anomaly_sql(places, value: str, shift: str = "0") -> str:
    rows = ", ".join(f"({a}, {n})" for a, n in places)
    return f""", d AS (SELECT *, row_number() OVER (ORDER BY time) - 1 AS rn FROM daily), st AS (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM daily),
pl(s, len) AS (VALUES {rows}),
x AS (SELECT s, len, (SELECT v FROM d WHERE rn = s) AS x0, (SELECT v FROM d WHERE rn = s - 1) AS before, (SELECT coalesce(sum(v), 0) FROM d WHERE rn < s) AS prefix,
(SELECT sum(v) FROM d WHERE rn >= s AND rn < s + len) AS total, (SELECT min(v) FROM d WHERE rn >= s AND rn < s + len) AS low FROM pl),
j AS (SELECT d.*, x.*, rn - s AS k FROM d LEFT JOIN x ON rn >= s AND rn < s + len)
SELECT time, round(({f"CASE WHEN s IS NULL THEN v ELSE {value} END" if shift == "0" else f"v + coalesce((SELECT sum({shift} * abs(x.x0 - x.before)) FROM x WHERE x.s <= j.rn), 0)"}), 4) AS v, (s IS NOT NULL)::INTEGER AS labels FROM j, st"""


_RAMP = "CASE WHEN floor(len * 0.4) > 0 AND least(k + 1, len - k) <= floor(len * 0.4) THEN least(k + 1, len - k) / (floor(len * 0.4) + 1) ELSE 1 END"
_ANOMALIES = {
    "anomaly_gap": (generation.AnomalyGeneration, "gap", {}, _LONG_PLACES, "NULL"),
    "anomaly_constant": (generation.AnomalyGeneration, "constant", {}, _LONG_PLACES, "x0"),
    "anomaly_constant_number": (generation.AnomalyGeneration, "constant", {"constant": 7.5}, _LONG_PLACES, "7.5"),
    "anomaly_negate": (generation.AnomalyGeneration, "negate", {}, _LONG_PLACES, "-v"),
    "anomaly_outlier": (generation.AnomalyGeneration, "outlier", {"outlier_sign": "positive", "random": False, "limits": (3, 0)}, _LONG_PLACES, "mean + 3 * std"),
    "anomaly_outlier_multiple": (generation.AnomalyGeneration, "outlier", {"outlier_type": "multiple", "outlier_sign": "negative", "random": False, "limits": (3, 0)}, _LONG_PLACES, "v * -3"),
    "anomaly_lag": (generation.AnomalyGeneration, "lag", {}, _LONG_PLACES, "CASE WHEN k = len - 1 THEN v ELSE 0 END"),
    "energy_type1": (generation.EnergyAnomalyGeneration, "type1", {}, _LONG_PLACES, "0"),
    "energy_type2": (generation.EnergyAnomalyGeneration, "type2", {}, _LONG_PLACES, "before"),
    "energy_type3": (generation.EnergyAnomalyGeneration, "type3", {"range_r": (2, 2)}, _SHORT_PLACES, ("-2",)),
    "energy_type4": (generation.EnergyAnomalyGeneration, "type4", {"range_r": (2, 2)}, _SHORT_PLACES, ("2",)),
    "power_type1": (generation.PowerAnomalyGeneration, "type1", {"k": 3}, _LONG_PLACES, "CASE WHEN k = 0 THEN -prefix - 3 WHEN k = len - 1 THEN prefix + total + 3 ELSE 0 END"),
    "power_type2": (generation.PowerAnomalyGeneration, "type2", {"softstart": False}, _LONG_PLACES, "CASE WHEN k = len - 1 THEN total ELSE 0 END"),
    "power_type3": (generation.PowerAnomalyGeneration, "type3", {"range_r": (2, 2)}, _SHORT_PLACES, "-2 * before"),
    "power_type3_extreme": (generation.PowerAnomalyGeneration, "type3", {"is_extreme": True, "k": 3}, _SHORT_PLACES, "-prefix - 3"),
    "power_type4": (generation.PowerAnomalyGeneration, "type4", {"range_r": (2, 2)}, _SHORT_PLACES, "2 * before"),
    "unusual_type1": (generation.UnusualBehaviour, "type1", {"min_factor": 0.5, "max_factor": 0.5}, _LONG_PLACES, "v - 0.5 * low"),
    "unusual_type2": (generation.UnusualBehaviour, "type2", {"min_factor": 0.5, "max_factor": 0.5}, _LONG_PLACES, "v + 0.5 * low"),
    "unusual_type3": (generation.UnusualBehaviour, "type3", {"min_factor": 0.5, "max_factor": 0.5, "transition": 0.4}, _LONG_PLACES, f"v - 0.5 * low * {_RAMP}"),
    "unusual_type4": (generation.UnusualBehaviour, "type4", {"min_factor": 0.5, "max_factor": 0.5, "transition": 0.4}, _LONG_PLACES, f"v + 0.5 * low * {_RAMP}"),
}
for _name, (_cls, _kind, _params, _places, _value) in _ANOMALIES.items():

    @query(_name, _anomaly_sql(_places, "", _value[0]) if isinstance(_value, tuple) else _anomaly_sql(_places, _value))
    def _(spark, d, cls=_cls, kind=_kind, params=_params, places=_places):
        got = cls(len(places), kind, params, places=places).transform(daily(spark, d))
        return out(got["v"]).join(got["labels"].frame(), "time")


@query("stream_window_mean", "SELECT k, time_bucket(INTERVAL 6 HOUR, time) AS time, count(v) AS n, round(avg(v), 4) AS mean FROM ev GROUP BY 1, 2")
def _(spark, d):
    e = events(spark, d)
    df = windowed(e.df.withColumn("time", F.col("time").cast("timestamp")), "time", "v", "6 hours", keys=("k",))
    return df.select("k", F.col("time").cast("timestamp_ntz").alias("time"), "n", F.round("mean", 4).alias("mean"))


_CENTRES = [[0.1] * 64, [-0.2] * 64, [((k % 5) - 2) / 10 for k in range(64)]]


@query("kmeans_distances", ", c AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {c}::DOUBLE[])" for k, c in enumerate(_CENTRES)) + """) t(i, c)),
e AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS x FROM embeddings),
d AS (SELECT vec_id, i, sqrt(list_sum(list_transform(list_zip(x, c[:len(x)]), lambda z: (z[1] - z[2]) ** 2))) AS f FROM e, c)
SELECT vec_id, array_to_string(list_transform(list(f ORDER BY i), lambda z: round(z, 4)::DECIMAL(38,4)::VARCHAR), ',') AS v FROM d GROUP BY vec_id""")
def _(spark, d):
    df = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    s = Series(df, "x", time="vec_id")
    width = df.select(F.size("x")).first()[0]
    m = models.KMeansDistances(given=[c[:width] for c in _CENTRES])
    return out(m.fit(x=s).transform(x=s))


@query("kmeans_fitted")
def _(spark, d):
    df = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    s = Series(df, "x", time="vec_id")
    return models.KMeansDistances(4).fit(x=s).transform(x=s).df


@query("gaussian_mixture")
def _(spark, d):
    f = _forecasts(spark, d)
    return models.Mixture(3).fit(a=f["p1"], b=f["p2"]).transform(a=f["p1"], b=f["p2"]).df


#: Least squares of v on two columns x1 and x2, from sums about the means.
_OLS2 = """m AS (SELECT avg(v) AS mv, avg(x1) AS m1, avg(x2) AS m2 FROM xs WHERE v IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
g AS (SELECT sum((x1 - m1) ** 2) AS a, sum((x1 - m1) * (x2 - m2)) AS b, sum((x2 - m2) ** 2) AS c, sum((x1 - m1) * (v - mv)) AS p, sum((x2 - m2) * (v - mv)) AS q
FROM xs, m WHERE v IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
w AS (SELECT (c * p - b * q) / (a * c - b * b) AS w1, (a * q - b * p) / (a * c - b * b) AS w2 FROM g)"""


@query("autoregression", f", xs AS (SELECT k, time, v, lag(v, 1) OVER {_W} AS x1, lag(v, 2) OVER {_W} AS x2 FROM seg), {_OLS2} SELECT k, time, round(mv + w1 * (x1 - m1) + w2 * (x2 - m2), 2) AS v FROM xs, m, w")
def _(spark, d):
    s = segments(spark, d)
    return out(models.AutoRegression(2).fit(s).transform(s), 2)


@query("autoregression_forecast", f""", xs AS (SELECT time, v, lag(v, 1) OVER (ORDER BY time) AS x1, lag(v, 2) OVER (ORDER BY time) AS x2 FROM daily), {_OLS2},
z AS (SELECT time AS t, v, lag(v) OVER (ORDER BY time) AS u, lag(time) OVER (ORDER BY time) AS s FROM daily ORDER BY time DESC LIMIT 1),
f1 AS (SELECT t, s, v, mv + w1 * (v - m1) + w2 * (u - m2) AS y1 FROM z, m, w), f2 AS (SELECT *, mv + w1 * (y1 - m1) + w2 * (v - m2) AS y2 FROM f1, m, w)
SELECT t + (t - s) AS time, round(y1, 2) AS v FROM f2 UNION ALL SELECT t + 2 * (t - s), round(y2, 2) FROM f2""")
def _(spark, d):
    s = daily(spark, d)
    return out(models.AutoRegression(2).fit(s).forecast(s, 2), 2)


@query("linreg_two_targets", f", {_FC}, r AS (SELECT regr_intercept(v, p1) AS i1, regr_slope(v, p1) AS s1, regr_intercept(p2, p1) AS i2, regr_slope(p2, p1) AS s2 FROM fc) SELECT k, time, round(i1 + s1 * p1, 2) AS v, round(i2 + s2 * p1, 2) AS w FROM fc, r")
def _(spark, d):
    f = _forecasts(spark, d)
    got = models.LinearRegression().fit(target_v=f["v"], target_w=f["p2"], p1=f["p1"]).transform(p1=f["p1"])
    return out(got["target_v"], 2).join(out(got["target_w"], 2, "w"), ["k", "time"])


@query("linreg_horizons", f", {_FC}, r AS (SELECT regr_intercept(v, p1) AS i1, regr_slope(v, p1) AS s1, regr_intercept(p2, p1) AS i2, regr_slope(p2, p1) AS s2 FROM fc) SELECT k, time, round(i1 + s1 * p1, 2) AS a, round(i2 + s2 * p1, 2) AS b FROM fc, r")
def _(spark, d):
    f = _forecasts(spark, d)
    both = f["v"].on(f["v"].df.withColumn("y", F.array("v", "p2")), "y")
    got = models.LinearRegression().fit(target=both, p1=f["p1"]).transform(p1=f["p1"])
    return got.df.select("k", "time", F.round(F.get("target", F.lit(0)), 2).alias("a"), F.round(F.get("target", F.lit(1)), 2).alias("b"))


@query("spark_ml_model", f", {_FC} SELECT k, time, round(i + s * p1, 2) AS v FROM fc, (SELECT regr_intercept(v, p1) AS i, regr_slope(v, p1) AS s FROM fc)")
def _(spark, d):
    from pyspark.ml.regression import LinearRegression as Line

    f = _forecasts(spark, d)
    m = models.SparkModel(Line(solver="normal")).fit(p1=f["p1"], target=f["v"])
    return out(m.transform(p1=f["p1"]), 2)


@query("support_vector_regression")
def _(spark, d):
    f = _forecasts(spark, d)
    return models.SVR().fit(target=f["v"], p1=f["p1"], p2=f["p2"]).transform(p1=f["p1"], p2=f["p2"]).df


@query("dense_network")
def _(spark, d):
    f = _forecasts(spark, d)
    m = networks.DlWrapper(networks.DenseNetwork((16,), epochs=5)).fit(target=f["v"], p1=f["p1"], p2=f["p2"])
    return m.transform(p1=f["p1"], p2=f["p2"]).df


@query("split_train", "SELECT time, round(v, 4) AS v FROM daily ORDER BY time LIMIT 1000")
def _(spark, d):
    s = daily(spark, d)
    return out(s.on(split_rows(s.df, 1000)[0]))


@query("split_test", "SELECT time, round(v, 4) AS v FROM daily ORDER BY time OFFSET 1000")
def _(spark, d):
    s = daily(spark, d)
    return out(s.on(split_rows(s.df, 1000)[1]))


@query("metric_filter", f", {_FC} SELECT 'MAE' AS summary, 'p1' AS key, round(avg(abs(p1 - v)), 4) AS value FROM fc WHERE p1 < v")
def _(spark, d):
    f = _forecasts(spark, d)
    return metrics.MAE(filter_method=lambda p, t: p < t).transform(f["v"], p1=f["p1"]).select("summary", "key", F.round("value", 4).alias("value"))


@query("rolling_outer_index", f"""SELECT x.k, x.time, round(coalesce(avg(y.v), 0), 4) AS v FROM (SELECT DISTINCT k, time + INTERVAL 12 HOUR AS time FROM seg) x
LEFT JOIN seg y ON x.k = y.k AND y.time < x.time AND y.time >= x.time - INTERVAL 7 DAY GROUP BY x.k, x.time""")
def _(spark, d):
    s = segments(spark, d)
    half = s.on(s.df.select("k", (F.col("time") + F.expr("INTERVAL 12 HOURS")).alias("time"), "v"))
    return out(features.RollingMean(7, "d").transform(s, index=half))


@query("drift_rmse_by_month", f", {_FC} SELECT date_trunc('month', time)::TIMESTAMP AS batch, round(sqrt(avg((p1 - v) ** 2)), 4) AS rmse FROM fc GROUP BY 1")
def _(spark, d):
    f = _forecasts(spark, d)
    return batch_rmse(f["v"], f["p1"], F.date_trunc("month", "time").cast("timestamp_ntz")).select("batch", F.round("rmse", 4).alias("rmse"))


@query("clean_training_rows", f""", x AS (SELECT k, time, lag(n, 2) OVER {_W} AS h1, lag(n, 1) OVER {_W} AS h2, n AS y1, lead(n, 1) OVER {_W} AS y2 FROM (SELECT k, time, (n::INT % 3)::DOUBLE AS n FROM seg))
SELECT k, time FROM x WHERE h1 IS NOT NULL AND h2 IS NOT NULL AND y2 IS NOT NULL AND y1 <> 0 AND y2 <> 0""")
def _(spark, d):
    s = segments(spark, d)
    n = s.on(s.df.withColumn("n", (F.col("n").cast("int") % 3).cast("double")), "n")
    back = lambda k: F.lag("n", k).over(n.window)
    df = n.df.select("k", "time", F.array(back(2), back(1)).alias("hist_input"), F.array(F.col("n"), F.lead("n", 1).over(n.window)).alias("y"))
    return preprocessing.clean_training_rows(df).select("k", "time")


def _graph(spark, d) -> tuple[Pipeline, DataFrame]:
    p = Pipeline(keys=("k",))
    scaler = models.StandardScaler()
    scaled = scaler(x=p["v"])
    lags = preprocessing.Select([-1])(x=scaled)
    forecast = models.LinearRegression(name="forecast")(lags=lags, target=scaled)
    scaler(x=forecast, method="inverse_transform", mode=Mode.TRANSFORM)
    return p, segments(spark, d).df


@query("pipeline_train_test", f""", a AS (SELECT k, time, v, lag(v) OVER {_W} AS x FROM seg WHERE time < TIMESTAMP '1997-01-01'), r AS (SELECT regr_intercept(v, x) AS i, regr_slope(v, x) AS s FROM a),
b AS (SELECT k, time, lag(v) OVER {_W} AS x FROM seg WHERE time >= TIMESTAMP '1997-01-01') SELECT k, time, round(i + s * x, 2) AS v FROM b, r WHERE x IS NOT NULL""")
def _(spark, d):
    p, df = _graph(spark, d)
    split = F.lit("1997-01-01").cast("timestamp_ntz")
    p.train(df.where(F.col("time") < split), summary=False)
    return out(next(iter(p.test(df.where(F.col("time") >= split), summary=False)[0].values())), 2)


@query("pipeline_columns", "SELECT k, time, round(n, 4) AS v FROM seg")
def _(spark, d):
    p = Pipeline(keys=("k",))
    p["n"]
    return out(p.test(segments(spark, d).df, summary=False)[0]["n"])


@query("pipeline_nested_batches", f"SELECT k, time, round(v - lag(v) OVER {_W}, 4) AS v FROM seg QUALIFY lag(v) OVER {_W} IS NOT NULL")
def _(spark, d):
    p, sub = Pipeline(keys=("k",)), Pipeline(batch="1000d", name="sub")
    preprocessing.Differentiate(1)(x=sub["x"])
    sub(x=p["v"])
    return out(next(iter(p.test(segments(spark, d).df, summary=False)[0].values())))


@query("pipeline_conditions", "SELECT k, time, round(v * 2.0, 4) AS v FROM seg")
def _(spark, d):
    p = Pipeline(keys=("k",))
    many = preprocessing.CustomScaler(2.0, name="many")(x=p["v"], condition=lambda x: x.df.limit(1).count() > 0)
    none = preprocessing.CustomScaler(bias=1.0, name="none")(x=p["v"], condition=lambda x: x.df.limit(1).count() == 0)
    preprocessing.CustomScaler(name="either")(x=(many, none))
    return out(p.test(segments(spark, d).df, summary=False)[0]["either"])
