"""Goldens of the time-series operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.errors import InputNotAvailable, WrongParameter
from tidewheel.frame import Series
from tidewheel.functions.windows import row_index
from tidewheel.operators import features, generation, metrics, models, preprocessing
from tidewheel.plans.pipeline import Pipeline
from tidewheel.sources.tables import split_rows
from tidewheel.streaming.online import Adwin, DriftCondition, PeriodicCondition

DAY = timedelta(days=1)


def series(spark, values, start=datetime(2002, 1, 1), step=DAY, kind="double"):
    rows = [(start + k * step, v if kind != "double" or v is None else float(v)) for k, v in enumerate(values)]
    return Series(spark.createDataFrame(rows, f"time timestamp_ntz, v {kind}"), "v")


def values(s):
    return [r[s.col] for r in s.df.orderBy(s.time).collect()]


def close(got, want):
    assert got == pytest.approx(want, nan_ok=True), got


def test_rolling(spark):
    x = series(spark, range(2, 9))
    close(values(features.RollingMean(3).transform(x)), [0, 2, 2.5, 3, 4, 5, 6])
    close(values(features.RollingVariance(3).transform(x)), [0, 0, 0.5, 1, 1, 1, 1])
    close(values(features.RollingKurtosis(3).transform(x)), [0] * 7)
    close(values(features.RollingSkewness(3).transform(series(spark, [2, 2, 2, 5, 8, 8, 8]))), [0, 0, 0, 0, 1.7320508, 0, -1.7320508])
    close(values(features.RollingMean(3, alpha=0.5).transform(series(spark, [1, 2, 4, 8, 16, 32, 64]))), [0, 1, 2.5 / 1.5, 3, 6, 12, 24])
    half = series(spark, [2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 42, 42], step=DAY / 2)
    close(values(features.RollingMean(3, group_by="WorkdayWeekend").transform(half)), [0, 0, 2, 2, 2.5, 2.5, 3, 3, 0, 0, 6, 6, 5, 5])
    close(values(features.RollingMean(4, group_by="WorkdayWeekendAndHoliday").transform(half)), [0, 0, 0, 0, 3, 3, 3.5, 3.5, 2, 2, 6, 6, 4.5, 4.5])


def predictions(spark):
    rows = zip((-2, -1, 0, 1, 2), (2, -3, 3, 1, -2), (4, 4, 3, -2, 1))
    df = spark.createDataFrame([(datetime(2015, 6, 3, k), *map(float, r)) for k, r in enumerate(rows)], "time timestamp_ntz, y double, pred1 double, pred2 double")
    return {c: Series(df, c) for c in ("y", "pred1", "pred2")}


def test_rolling_errors(spark):
    p = predictions(spark)
    got = features.RollingMAE(2, "h").transform(p["y"], gt=p["y"], pred1=p["pred1"])
    close(values(got["gt"]), [0] * 5)
    close(values(got["pred1"]), [4, 3, 2.5, 1.5, 2])
    close(values(features.RollingRMSE(2, "h").transform(p["y"], p=p["pred2"])["p"]), [6, 30.5**0.5, 17**0.5, 3, 5**0.5])


@pytest.mark.parametrize(
    "metric, want",
    [(metrics.MAE(), (2.6, 3.6, 5 / 3)), (metrics.RMSE(), (3, 4, (13 / 3) ** 0.5)), (metrics.MAPE(), (150, 287.5, 100)), (metrics.MASE(), (2.25, 3, 1.5)), (metrics.MaxErr(), (4, 6, 3)), (metrics.MinErr(), (0, 1, 0))],
)
def test_metrics(spark, metric, want):
    p = predictions(spark)
    metric.cuts = [(datetime(2015, 6, 3, 1), datetime(2015, 6, 3, 3))]
    got = {r["key"]: r["value"] for r in metric.transform(p["y"], pred1=p["pred1"], pred2=p["pred2"]).collect()}
    close([got["pred1"], got["pred2"], got["pred1: Cut from 2015-06-03 01:00:00 to 2015-06-03 03:00:00"]], list(want))
    with pytest.raises(InputNotAvailable):
        metric.transform(p["y"])


def test_lags(spark):
    x = series(spark, range(1, 8))
    assert values(preprocessing.Select(1, 4, 1).transform(x)) == [[2, 3, 4], [3, 4, 5], [4, 5, 6], [5, 6, 7]]
    assert values(preprocessing.Select(2).transform(x)) == [3, 4, 5, 6, 7]
    assert values(preprocessing.Sampler(3).transform(x))[0] == [1, 2, 3]
    assert values(preprocessing.ChangeDirection().transform(series(spark, [2, 3, 4, 3, 3, 1, 2]))) == [None, 1, 1, -1, 0, -1, 1]
    assert values(preprocessing.TrendExtraction(2, 3).transform(series(spark, [*range(2, 11), 42])))[6:8] == [[6, 4, 2], [7, 5, 3]]
    assert values(preprocessing.Differentiate(2, pad=True).transform(x)) == [0] * 7
    assert values(preprocessing.Slicer(1, -1).transform(x)) == [2, 3, 4, 5, 6]
    for bad in (lambda: preprocessing.Select(2, 2), lambda: preprocessing.Sampler(0), lambda: preprocessing.CustomScaler(0)):
        with pytest.raises(WrongParameter):
            bad()


@pytest.mark.parametrize("given", [[1, 2, None, 4, 5], [None, 2, 3, 4, 5], [1, 2, 3, 4, None], [1, None, None, None, 5]])
def test_interpolation(spark, given):
    close(values(preprocessing.LinearInterpolater().transform(series(spark, given))), [1, 2, 3, 4, 5])


def test_horizons(spark):
    h = series(spark, [[0.0, 0.0, 1.0], *[[float(k), k + 1.0, k + 2.0] for k in range(6)]], kind="array<double>")
    for method in ("mean", "median"):
        assert values(preprocessing.Merger(method).transform(h))[:3] == [None, None, pytest.approx(1.0)]
    assert values(preprocessing.Merger(-10).transform(h)) == [0, 0, 1, 2, 3, 4, 5]
    s = series(spark, [[0.0, 0.0], [1.0, 3.0], [1.0, 5.0]], kind="array<double>")
    assert values(preprocessing.StatisticExtraction().transform(s)) == [[0, 0, 0, 0], [1, 3, 1, 2], [1, 5, 2, 3]]


def test_ensemble(spark):
    s = {k: series(spark, [v + i for i in range(7)]) for k, v in dict(a=2, b=3, c=2, d=5, e=12, target=3).items()}
    e = metrics.Ensemble(k_best="auto").fit(**s)
    assert e.state["weights"] == [0.25, 0.25, 0.25, 0.25, 0]
    assert metrics.Ensemble(weights=[3, 1]).fit(a=s["a"], b=s["b"], target=s["target"]).state["weights"] == [0.75, 0.25]
    with pytest.raises(WrongParameter):
        metrics.Ensemble(k_best=9).fit(**s)


def test_generators(spark):
    x = series(spark, range(1, 8))
    drift = generation.DriftInsertion([generation.DriftInformation([1, 2], datetime(2002, 1, 1), 2)])
    assert values(drift.transform(x)) == [2, 4, 5, 6, 7, 8, 9]
    ones = series(spark, [1] * 10)
    got = generation.AnomalyGeneration(2, "negate").transform(ones)
    assert sorted(values(got["v"])) == [-1, -1] + [1] * 8 and sum(values(got["labels"])) == 2
    with pytest.raises(WrongParameter):
        generation.AnomalyGeneration(11, "gap").transform(ones)
    for cls, kind, size in ((generation.PowerAnomalyGeneration, "type1", 3), (generation.UnusualBehaviour, "type3", 4), (generation.EnergyAnomalyGeneration, "type1", 2)):
        got = cls(1, kind, length_params={"min": size, "max": size}).transform(ones)
        assert sum(values(got["labels"])) == size


def test_models(spark):
    y = series(spark, [2] * 5)
    assert values(models.StandardScaler().fit(y).transform(y)) == [0] * 5
    a, b = series(spark, [1, 2, 3, 4, 7]), series(spark, [2, 1, 5, 3, 4])
    t = series(spark, [1 + 2 + 2, 2 + 1 + 2, 3 + 5 + 2, 4 + 3 + 2, 7 + 4 + 2])
    close(values(models.LinearRegression().fit(a=a, b=b, target=t).transform(a=a, b=b)), values(t))


def test_conditions():
    assert [c.evaluate() for c in [PeriodicCondition(2)] for _ in range(3)] == [False, True, False]
    a = Adwin()
    assert not any(a.update(0.1) for _ in range(200)) and any(a.update(0.9) for _ in range(200))
    assert not DriftCondition().feed(1.0)


def test_pipeline_round_trip(spark, tmp_path):
    x = series(spark, range(1, 20)).df
    p = Pipeline()
    scaler = models.StandardScaler()
    scaled = scaler(x=p["v"])
    lags = preprocessing.Select(-2, 0, 1)(x=scaled)
    forecast = models.LinearRegression(name="forecast")(lags=lags, target=scaled)
    back = scaler(x=forecast, method="inverse_transform", mode=__import__("tidewheel.plans.pipeline", fromlist=["Mode"]).Mode.TRANSFORM)
    metrics.RMSE()(y=p["v"], forecast=back)
    p.train(x)
    _, text, tables = p.test(x)
    assert tables["RMSE"].first()["value"] < 1e-6 and "Fit seconds" in text
    p.to_folder(str(tmp_path))
    assert Pipeline.from_folder(str(tmp_path)).test(x)[2]["RMSE"].first()["value"] < 1e-6


def wide(spark, n=5000):
    hours = F.col("id") * 3600 + F.pmod(F.xxhash64("id"), F.lit(3000))
    df = spark.range(n, numPartitions=7).select(F.timestamp_seconds(hours).cast("timestamp_ntz").alias("time"), (F.col("id") * 2.5).alias("v"), F.lit("x" * 50).alias("w"))
    return df.repartition(5)


@pytest.mark.parametrize("parts", [4, 8, 200])
def test_row_index_counts_every_row_once(spark, parts):
    df = wide(spark)
    for some in (df, df.select("time")):
        got = row_index(some, parts=parts)
        want = some.withColumn("rn", F.row_number().over(Window.orderBy("time")) - 1)
        assert got.count() == 5000 and got.exceptAll(want.select(got.columns)).count() == 0


def test_row_index_of_numbers_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (2,)], "time long")
    assert [r["rn"] for r in row_index(df).orderBy("time").collect()] == [0, 1, 2, 3]
    assert row_index(df.where("time > 9")).count() == 0


def test_split_rows_is_exact(spark):
    first, rest = split_rows(wide(spark), 1000)
    assert (first.count(), rest.count()) == (1000, 4000)
    assert first.agg(F.max("time")).first()[0] < rest.agg(F.min("time")).first()[0]
