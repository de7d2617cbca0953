"""The workflow graph: nested pipelines, refits, batches, history, conditions, copies, saving, and online runs."""

from datetime import datetime, timedelta

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import LinearRegression as SparkLinear
from pyspark.sql import functions as F

from tidewheel.errors import InputNotAvailable, StepCreation
from tidewheel.frame import Series
from tidewheel.operators import features, metrics, models, preprocessing
from tidewheel.plans.pipeline import Mode, Pipeline
from tidewheel.sources.tables import CSVCallback, ParquetCallback, StatisticCallback, read_csv
from tidewheel.streaming.online import DriftCondition, OnlineRunner, PeriodicCondition, batch_rmse

HOUR = timedelta(hours=1)


def table(spark, n, start=0, f=lambda k: float(k)):
    return spark.createDataFrame([(datetime(2020, 1, 1) + k * HOUR, f(k)) for k in range(start, start + n)], "time timestamp_ntz, v double")


def values(s):
    return [r[s.col] for r in s.df.orderBy(s.time).collect()]


def lagged_graph(**options):
    """Scaled values, their lags by a nested pipeline, a regression and the way back, as in an online forecast."""
    p = Pipeline()
    scaler = models.StandardScaler()
    scaled = scaler(x=p["v"])
    sub = Pipeline(name="lags")
    preprocessing.Select(-2, 0, 1, name="sampled")(x=sub["scaled"])
    lags = sub(scaled=scaled)
    forecast = models.LinearRegression(name="regression")(lags=lags["sampled"], target=scaled, **options)
    scaler(x=forecast, method="inverse_transform", mode=Mode.TRANSFORM)
    return p, scaled, forecast


def test_nested_pipeline_is_trained_and_tested(spark):
    p, *_ = lagged_graph()
    p.train(table(spark, 40))
    out = p.test(table(spark, 10, 40))[0]
    assert values(next(iter(out.values()))) == pytest.approx(list(range(42, 50)))
    assert p.need() == (2, 0)
    again = p.clone()
    assert values(next(iter(again.test(table(spark, 10, 40))[0].values()))) == pytest.approx(list(range(42, 50)))
    assert again.steps["regression"].module is not p.steps["regression"].module


def test_nested_pipeline_with_an_estimator_of_its_own(spark):
    p, sub = Pipeline(), Pipeline(name="sub")
    models.StandardScaler(name="own")(x=sub["x"])
    sub(x=p["v"])
    p.train(table(spark, 5))
    assert values(next(iter(p.test(table(spark, 5))[0].values())))[2] == 0
    assert sub.steps["own"].module.state["mean"] == 2


def test_rows_one_by_one_keep_their_history(spark):
    p, *_ = lagged_graph()
    p.train(table(spark, 40))
    got = []
    for k in range(40, 45):
        got += values(next(iter(p.test(table(spark, 1, k), reset=False, summary=False)[0].values())))
    assert got == pytest.approx([42, 43, 44])
    assert values(p.steps["regression"].buffer)[-1] is not None and p.steps["regression"].buffer.df.count() == 3
    assert p.test(table(spark, 2, 60))[0] is not None and p._past is None


def test_refit_conditions_and_lag(spark):
    every, drift = PeriodicCondition(2), DriftCondition()
    p, scaled, forecast = lagged_graph(mode=Mode.REFIT, lag=timedelta(hours=1), refit_conditions=[every, drift])
    p.train(table(spark, 40))
    assert drift(y=scaled, y_hat=forecast) is drift
    before = p.steps["regression"].module.state
    p.test(table(spark, 6, 40), reset=False, refit=True)
    assert p.steps["regression"].refits == 0 and p.steps["regression"].module.state is before
    p.test(table(spark, 6, 46, lambda k: 5.0 - k), reset=False, refit=True)
    assert p.steps["regression"].refits == 1 and p.steps["regression"].module.state is not before
    p.test(table(spark, 6, 52), reset=False)
    assert p.steps["regression"].refits == 1


def test_condition_inputs_are_checked(spark):
    p = Pipeline()
    s = p["v"]
    for bad in ({"y": s}, {"y": s, "y_hat": s, "x": s}):
        with pytest.raises(StepCreation):
            DriftCondition()(**bad)
    with pytest.raises(StepCreation):
        models.LinearRegression()(x=s, target=s, refit_conditions=[PeriodicCondition(2)])


def test_batches_of_a_sub_pipeline(spark):
    calls = []

    def note(x):
        calls.append(x.df.count())
        return x

    p, sub = Pipeline(), Pipeline(batch="6h", name="sub")
    models.FunctionModule(note, name="note")(x=sub["x"])
    sub(x=p["v"])
    out = p.test(table(spark, 15))[0]
    assert values(next(iter(out.values()))) == list(range(15)) and calls == [6, 12, 15]


def test_conditional_steps(spark):
    p = Pipeline()
    small = preprocessing.CustomScaler(2.0, name="small")(x=p["v"], condition=lambda x: x.df.agg(F.max(x.col)).first()[0] < 10)
    large = preprocessing.CustomScaler(bias=1.0, name="large")(x=p["v"], condition=lambda x: x.df.agg(F.max(x.col)).first()[0] >= 10)
    preprocessing.CustomScaler(name="either")(x=(small, large))
    assert values(p.test(table(spark, 3))[0]["either"]) == [0, 2, 4]
    assert values(p.test(table(spark, 3, 10))[0]["either"]) == [11, 12, 13]
    with pytest.raises(InputNotAvailable):
        p.test(table(spark, 3).drop("v"))


def test_all_of_a_graph_is_saved(spark, tmp_path):
    p, sub = Pipeline(), Pipeline(name="sub", batch="6h")
    models.StandardScaler(name="own")(x=sub["x"])
    scaled = sub(x=p["v"])
    models.KMeansDistances(2, name="far")(x=scaled)
    models.Mixture(2, name="mix")(x=p["v"])
    models.SparkModel(SparkLinear(regParam=0.1), name="line")(x=scaled, target=p["v"])
    models.SparkModel(KMeans(k=2, seed=1), name="near")(x=p["v"])
    models.FunctionModule(lambda x: x.with_value(F.col(x.col) + 1), name="plus")(x=p["v"], condition=lambda x: True, callbacks=[CSVCallback("c", str(tmp_path))])
    every = PeriodicCondition(3)
    models.LinearRegression(name="again")(x=scaled, target=p["v"], mode=Mode.REFIT, lag="2h", refit_conditions=[every, DriftCondition()(y=p["v"], y_hat=scaled)])
    p.train(table(spark, 20))
    p.to_folder(str(tmp_path / "saved"))
    q = Pipeline.from_folder(str(tmp_path / "saved"))
    a, b = p.test(table(spark, 9, 5))[0], q.test(table(spark, 9, 5))[0]
    assert set(a) == set(b) >= {"far", "mix", "line", "near", "plus", "again"}
    for n in a:
        assert values(a[n]) == pytest.approx(values(b[n])) if not a[n].is_array else values(a[n]) == values(b[n])
    step = q.steps["again"]
    assert step.lag == 7_200_000_000 and step.mode is Mode.REFIT and step.refit_conditions[0].num_steps == 3
    assert step.refit_conditions[1].inputs["y"] is q.steps["v"]
    assert read_csv(spark, str(tmp_path / "c_plus.csv"), "time timestamp_ntz, v double").count() == 9


def test_a_model_of_several_targets_leaves_out_rows_without_features(spark):
    df = table(spark, 10).withColumn("w", F.col("v") * 2 + 1).withColumn("x", F.when(F.col("v") != 3, F.col("v")))
    s = {c: Series(df, c) for c in ("v", "w", "x")}
    m = models.SparkModel(SparkLinear()).fit(x=s["x"], target_v=s["v"], target_w=s["w"])
    got = m.transform(x=s["x"])
    assert set(got) == {"target_v", "target_w"} and values(got["target_w"]) == pytest.approx([2 * k + 1 for k in range(10) if k != 3], abs=1e-4)


def test_callbacks_write(spark, tmp_path):
    x = Series(table(spark, 5), "v")
    for c in (ParquetCallback("a", str(tmp_path)), CSVCallback("a", str(tmp_path)), StatisticCallback("a", str(tmp_path)), StatisticCallback("a", str(tmp_path))):
        c({"r": x})
    assert spark.read.parquet(str(tmp_path / "a_r.parquet")).count() == 5
    assert (tmp_path / "a_Statistics.md").read_text().count("# r") == 1
    back = read_csv(spark, str(tmp_path / "a_r.csv"), "time timestamp_ntz, v double")
    assert back.columns == ["time", "v"] and back.agg(F.sum("v")).first()[0] == 10


def test_rmse_of_batches(spark):
    df = table(spark, 48).withColumn("p", F.col("v") + F.when(F.hour("time") < 12, 1.0).otherwise(3.0))
    got = batch_rmse(Series(df, "v"), Series(df, "p"), F.to_date("time")).collect()
    assert len(got) == 2 and all(r["rmse"] == pytest.approx(5**0.5) for r in got)
    assert batch_rmse(Series(df, "v"), Series(df, "p")).first()["rmse"] == pytest.approx(5**0.5)


def test_online_runner_in_a_stream(spark, tmp_path):
    source, got = tmp_path / "in", {}
    p = Pipeline()
    features.RollingMean(3, "h", closed="right", name="mean")(x=p["v"])
    p.train(table(spark, 2))
    runner = OnlineRunner(p, f"file://{tmp_path}/history", lambda b, r: got.update({b: values(r["mean"])}), conditions=[PeriodicCondition(2)], refit_micros=0)
    for k in range(4):
        table(spark, 4, 4 * k).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("time timestamp_ntz, v double").parquet(str(source)).writeStream.foreachBatch(runner)
        stream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    want = [sum(range(max(0, k - 2), k + 1)) / len(range(max(0, k - 2), k + 1)) for k in range(16)]
    assert sum((got[b] for b in sorted(got)), []) == pytest.approx(want)
    assert runner.refits == [1, 3]
    kept = [f for f in (tmp_path / "history").iterdir() if f.name.startswith("end=")]
    assert len(kept) <= 2  # older batches are deleted
    before = got[3]
    runner(table(spark, 4, 12), 3)  # a batch that runs again
    assert got[3] == pytest.approx(before)


def test_f1_counts_after_the_offset_and_what_the_filter_lets_through(spark):
    rows = [(datetime(2020, 1, 1) + k * HOUR, t, p) for k, (t, p) in enumerate([(0, 1), (1, 0), (0, 0), (1, 1), (2, 2)])]
    df = spark.createDataFrame(rows, "time timestamp_ntz, t int, p int")
    t, p = Series(df, "t"), Series(df, "p")
    for average in ("macro", "weighted", "micro"):
        assert metrics.F1Score(average, offset=2).transform(t, p=p).first()["value"] == 1.0
        assert metrics.F1Score(average, filter_method=lambda p, t: p == t).transform(t, p=p).first()["value"] == 1.0
        assert metrics.F1Score(average).transform(t, p=p).first()["value"] < 1.0
