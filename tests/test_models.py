"""Fitted models, networks, evaluation of synthetic data, and what else has no SQL."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.errors import InputNotAvailable, WrongParameter
from tidewheel.frame import Series
from tidewheel.operators import evaluation, features, metrics, models, networks, preprocessing

HOUR = timedelta(hours=1)


def frame(spark, rows, schema):
    return spark.createDataFrame([(datetime(2020, 1, 1) + k * HOUR, *r) for k, r in enumerate(rows)], f"time timestamp_ntz, {schema}")


def values(s):
    return [r[s.col] for r in s.df.orderBy(s.time).collect()]


@pytest.fixture(scope="module")
def curve(spark):
    rng = random.Random(1)
    return frame(spark, [(x := rng.uniform(-3, 3), math.sin(x), float(abs(x) > 1.5)) for _ in range(600)], "x double, y double, c double")


def test_kernel_machines(curve):
    x, y, c = (Series(curve, n) for n in ("x", "y", "c"))
    got = models.SVR(C=100.0).fit(x=x, target=y).transform(x=x)
    assert np.abs(np.array(values(got)) - np.array(values(y))).max() < 0.1
    got = models.SVC(C=100.0).fit(x=x, target=c).transform(x=x)
    assert np.mean(np.array(values(got)) == np.array(values(c))) > 0.97
    with pytest.raises(WrongParameter):
        models.SVR(C=0)


def test_dense_network_gradients_and_fit(curve):
    net = networks.DenseNetwork((7,), epochs=1)
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((20, 3)), rng.standard_normal((20, 2))
    net.fit({"a": a}, {"b": b})
    loss = lambda: ((net._forward(a)[-1] - b) ** 2).sum() / len(a)
    for k, (gw, gc) in enumerate(net._gradients(a, b)):
        for i, g in ((0, gw), (1, gc)):
            own = net.layers[k][i]
            at = tuple(0 for _ in own.shape)
            own[at] += 1e-6
            up = loss()
            own[at] -= 2e-6
            down = loss()
            own[at] += 1e-6
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)
    x, y = Series(curve, "x"), Series(curve, "y")
    m = networks.DlWrapper(networks.DenseNetwork((32, 32), epochs=150, validation_split=0.1)).fit(x=x, target=y)
    assert np.abs(np.array(values(m.transform(x=x)))[:, 0] - np.array(values(y))).mean() < 0.1
    assert values(m.clone().transform(x=x)) == values(m.transform(x=x))
    with pytest.raises(InputNotAvailable):
        m.fit(x=x)


def test_adapter_of_a_compiled_model_with_two_targets(curve):
    class Mean:
        def compile(self, **options):
            self.options = options

        def fit(self, x, y, **options):
            self.value = {n: v.mean(0) for n, v in y.items()}

        def predict(self, x):
            return {n: np.tile(v, (len(next(iter(x.values()))), 1)) for n, v in self.value.items()}

    x, y, c = (Series(curve, n) for n in ("x", "y", "c"))
    m = networks.KerasWrapper(Mean(), compile_kwargs={"loss": "mse"}).fit(x=x, target=y, target_c=c)
    got = m.transform(x=x)
    assert set(got) == {"target", "target_c"} and m.model.options == {"loss": "mse"}
    assert values(got["target_c"])[0][0] == pytest.approx(np.mean(values(c)))
    with pytest.raises(WrongParameter):
        networks.PyTorchWrapper(Mean())


def test_profile_network(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        level = rng.uniform(1, 2)
        profile = [2.0 + math.sin(k + h) for h in range(3)]
        rows.append(([level + rng.random() * 1e-3 for _ in range(4)], [level] * 2, profile, [float(k % 2)], [p + level for p in profile]))
    rows[0] = (None, *rows[0][1:])
    df = frame(spark, rows, "h array<double>, t array<double>, p array<double>, d array<double>, y array<double>")
    s = {k: Series(df, c) for k, c in (("historical_input", "h"), ("trend", "t"), ("profile", "p"), ("dummy", "d"))}
    m = networks.ProfileNeuralNetwork(epochs=60, offset=2).fit(**s, target=Series(df, "y"))
    got = m.transform(**s)
    assert got.df.count() == 399
    assert np.abs(np.array(values(got)) - np.array([r[4] for r in rows[1:]])).mean() < 0.1
    with pytest.raises(InputNotAvailable):
        m.fit(profile=s["profile"], target=Series(df, "y"))


def test_training_rows_are_cleaned(spark):
    rows = [([1.0, 2.0], [1.0]), ([1.0, None], [1.0]), ([1.0, 2.0], [0.0]), ([5.0] * 5, [1.0]), ([5.0] * 3 + [1.0], [2.0])]
    df = frame(spark, rows, "hist_input array<double>, y array<double>")
    kept = [r["hist_input"] for r in preprocessing.clean_training_rows(df).orderBy("time").collect()]
    assert kept == [[1.0, 2.0], [5.0, 5.0, 5.0, 1.0]]


def test_forecasts_go_on_from_their_own_values(spark):
    v = [1.0, 2.0]
    for _ in range(40):
        v.append(0.5 * v[-1] + 0.3 * v[-2] + 1)
    s = Series(frame(spark, [(x,) for x in v[:30]], "v double"), "v")
    m = models.AutoRegression(2).fit(s)
    got = m.forecast(s, 5).df.orderBy("time").collect()
    assert [r["v"] for r in got] == pytest.approx(v[30:35], rel=1e-5) and got[0]["time"] == datetime(2020, 1, 1) + 30 * HOUR
    keyed = Series(s.df.withColumn("k", F.lit("a")).unionByName(s.df.withColumn("k", F.lit("b"))), "v", keys=("k",))
    assert models.AutoRegression(2).fit(keyed).forecast(keyed, 3).df.groupBy("k").count().count() == 2


def arrays(spark, f, n=300, seed=0):
    rng = random.Random(seed)
    return Series(frame(spark, [(f(rng),) for _ in range(n)], "x array<double>"), "x")


def test_evaluation_of_synthetic_data(spark):
    line = lambda r: [a := r.random(), b := r.random(), a + b]
    noise = lambda r: [r.random() + 5 for _ in range(3)]
    real, good, bad = arrays(spark, line), arrays(spark, line, seed=1), arrays(spark, noise, seed=2)
    mask = good.with_value(F.hour("time") < 22, "m")
    score = {(r["name"], r["key"]): r["value"] for r in evaluation.DiscriminativeScore(2).transform(real, good=good, bad=bad, good_mask=mask).collect()}
    assert score["good", "mean"] < 0.2 < 0.4 < score["bad", "mean"]
    tstr = evaluation.TrainSyntheticTestReal(repetitions=2, metrics=["rmse", "mae", "mape"])
    got = {(r["name"], r["key"]): r["value"] for r in tstr.transform(real, good=good, bad=bad, good_mask=mask).collect()}
    assert len(got) == 3 * 3 * 4 and got["real: rmse", "max"] < 1e-6 and got["good: mae", "sum"] < 1e-6 < got["bad: rmse", "min"]
    kind = lambda r: [a := r.random(), float(a > 0.5)]
    tstr = evaluation.TrainSyntheticTestReal(repetitions=1, task="classification")
    got = {(r["name"], r["key"]): r["value"] for r in tstr.transform(arrays(spark, kind), other=arrays(spark, kind, seed=5)).collect()}
    assert got["other: accuracy", "mean"] > 0.9 and got["other: f1", "mean"] > 0.9
    plane = evaluation.PlaneSummary(60, rounds=60).transform(real, bad=bad, bad_mask=bad.with_value(F.lit(True), "m")).toPandas()
    assert plane.groupby("name").size().to_dict() == {"gt": 30, "bad": 30} and np.isfinite(plane[["x", "y"]].to_numpy()).all()


def test_rolling_over_an_outer_index_and_other_time_columns(spark):
    df = frame(spark, [(float(k),) for k in range(6)], "v double").withColumnRenamed("time", "at")
    x = Series(df, "v", time="at")
    later = Series(frame(spark, [(0.0,)] * 8, "w double").withColumnRenamed("time", "at"), "w", time="at")
    got = features.RollingMean(2, "h").transform(x, index=later)
    assert values(got) == [0, 0, 0.5, 1.5, 2.5, 3.5, 4.5, 5]
    assert values(features.RollingMean(2, "h", alpha=0.5).transform(x))[2] == pytest.approx((1 + 0 * 0.5) / 1.5)


def test_long_rolling_windows_in_buckets(spark):
    n = 3000
    df = frame(spark, [(float((k * 7919) % 101),) for k in range(n)], "v double")
    v = [float((k * 7919) % 101) for k in range(n)]
    for closed, lo, hi in (("left", 5, 0), ("both", 5, 1), ("right", 4, 1), ("neither", 4, 0)):
        got = values(features.RollingMean(5, "h", closed=closed).transform(Series(df, "v")))
        want = [np.mean(w) if (w := v[max(0, k - lo) : k + hi]) else 0.0 for k in range(n)]
        assert got == pytest.approx(want)


def test_filtered_metrics_and_other_interpolations(spark):
    df = frame(spark, [(1.0, 2.0), (2.0, 2.0), (3.0, 9.0)], "y double, p double")
    got = metrics.MAE(filter_method=lambda p, t: t < 3).transform(Series(df, "y"), p=Series(df, "p")).first()["value"]
    assert got == 0.5
    gaps = Series(frame(spark, [(1.0,), (None,), (None,), (4.0,), (None,)], "v double"), "v")
    for method, want in (("previous", [1, 1, 1, 4, 4]), ("zero", [1, 1, 1, 4, 4]), ("next", [1, 4, 4, 4, 4]), ("slinear", [1, 2, 3, 4, 5])):
        assert values(preprocessing.LinearInterpolater(method).transform(gaps)) == want
    assert values(preprocessing.LinearInterpolater("linear", None).transform(gaps)) == [1, 2, 3, 4, None]
