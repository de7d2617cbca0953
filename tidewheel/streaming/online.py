"""Online execution: conditions, drift detection, refits per micro-batch and event-time aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import WrongParameter
from ..frame import Series, align


class Condition:
    """Asked by ``evaluate`` when all steps of a run are done; wired to steps by call."""

    name = "Condition"
    inputs: dict | None = None

    def __call__(self, **inputs):
        from ..plans.pipeline import wire_condition

        wire_condition(self, inputs)
        return self


class PeriodicCondition(Condition):
    """True on every ``num_steps``-th call."""

    def __init__(self, num_steps: int = 10, name: str = "PeriodicCondition") -> None:
        if num_steps < 1:
            raise WrongParameter("num_steps is below 1.", f"It is {num_steps}.")
        self.num_steps, self.name, self.counter = num_steps, name, 0

    def evaluate(self) -> bool:
        self.counter += 1
        return self.counter % self.num_steps == 0


class Adwin:
    """Adaptive windowing (Bifet and Gavaldà, 2007): exponential histogram buckets, cut where two sub-windows' means differ."""

    def __init__(self, delta: float = 0.002, per_row: int = 5, least: int = 5) -> None:
        self.delta, self.per_row, self.least = delta, per_row, least
        self.reset()

    def reset(self) -> None:
        self.rows: list[list[tuple[int, float, float]]] = []  # (n, mean, squared deviations), oldest last
        self.change_detected = False

    def update(self, x: float) -> bool:
        if not self.rows:
            self.rows.append([])
        self.rows[0].insert(0, (1, x, 0.0))
        k = 0
        while len(self.rows[k]) > self.per_row:
            b, a = self.rows[k].pop(), self.rows[k].pop()
            if k + 1 == len(self.rows):
                self.rows.append([])
            self.rows[k + 1].insert(0, _merge(a, b))
            k += 1
        self.change_detected = False
        while self._cut():
            self.change_detected = True
        return self.change_detected

    def _cut(self) -> bool:
        buckets = [b for row in self.rows for b in row]  # newest first
        total = (0, 0.0, 0.0)
        for b in buckets:
            total = _merge(total, b)
        if total[0] < 2 * self.least:
            return False
        var, new, old = total[2] / total[0], (0, 0.0, 0.0), None
        d = math.log(2 * math.log(max(total[0], 3)) / self.delta)
        for k, b in enumerate(buckets[:-1]):
            new = _merge(new, b)
            n0, n1 = new[0], total[0] - new[0]
            if n0 < self.least or n1 < self.least:
                continue
            old = (total[0] * total[1] - n0 * new[1]) / n1
            m = 1 / (1 / n0 + 1 / n1)
            if abs(new[1] - old) > math.sqrt(2 / m * var * d) + 2 / (3 * m) * d:
                while self.rows and not self.rows[-1]:
                    self.rows.pop()
                self.rows[-1].pop()
                return True
        return False


def _merge(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    n = a[0] + b[0]
    if not n:
        return a
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


def batch_rmse(y: Series, y_hat: Series, by=None) -> DataFrame:
    """RMSE of a batch, or of each of several: ``by`` is a Column that tells them apart."""
    df, s = align({"y": y, "p": y_hat})
    d = F.col("p").cast("double") - F.col("y").cast("double")
    return df.groupBy(*([] if by is None else [by.alias("batch")])).agg(F.sqrt(F.avg(d * d)).alias("rmse"))


class DriftCondition(Condition):
    """Feeds the RMSE of each batch to a detector; true where that finds a change, after which it starts anew."""

    def __init__(self, detector=None, name: str = "DriftCondition") -> None:
        self.detector, self.name = detector or Adwin(), name

    def evaluate(self, y: Series, y_hat: Series) -> bool:
        rmse = batch_rmse(y, y_hat).first()["rmse"]
        return False if rmse is None or math.isnan(rmse) else self.feed(rmse)

    def feed(self, rmse: float) -> bool:
        self.detector.update(rmse)
        if getattr(self.detector, "change_detected", False) or getattr(self.detector, "drift_detected", False):
            self.detector.reset() if hasattr(self.detector, "reset") else None
            return True
        return False


class OnlineRunner:
    """``foreachBatch`` handler: tests each batch with the history its steps need, then refits where a condition holds.

    History is a table in folders by batch, so a batch that runs again gives
    the same. ``keep_micros`` is how much of it a test reads, by default what
    ``pipeline.need()`` asks for (rows by the batch's median step). Refits use
    ``refit_micros`` of it (all that is kept by default) without what is newer
    than ``lag`` before the batch's end. Folders that neither needs any more
    are deleted. ``sink(batch_id, results)`` gets each batch's results.
    """

    def __init__(self, pipeline, history: str, sink: Callable, keep_micros: int | None = None, lag_micros: int = 0, conditions: list | None = None, inputs: Callable | None = None, refit_micros: int | None = None) -> None:
        self.pipeline, self.history, self.sink, self.keep = pipeline, history, sink, keep_micros
        self.lag, self.conditions, self.inputs, self.refit_micros = lag_micros, conditions or [], inputs, refit_micros
        self.refits: list[int] = []

    def _folders(self, spark):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.history)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return fs, {}
        names = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("end=")]
        return fs, {p: tuple(int(x.split("=")[1]) for x in p.getName().split(",")) for p in names}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, time = batch.sparkSession, self.pipeline.time_column
        batch = batch.persist()
        us = F.unix_micros(F.col(time).cast("timestamp"))
        ends = batch.agg(F.min(us), F.max(us), F.count_distinct(us)).first()
        if ends[0] is None:
            return
        keep = self.keep
        if keep is None:
            rows, span = self.pipeline.need()
            keep = span + rows * max(1, (ends[1] - ends[0]) // max(1, ends[2] - 1) if ends[2] > 1 else 86_400_000_000)
        reach = max(keep, self.refit_micros or 0)
        fs, folders = self._folders(spark)  # of each, the newest time in it and the batch
        used = [p for p, (end, b) in folders.items() if end >= ends[0] - reach and b != batch_id]
        both = batch
        if used:
            past = spark.read.schema(batch.schema).parquet(*[str(p) for p in used]).where((us < ends[0]) & (us >= ends[0] - reach))
            both = past.unionByName(batch)
        results = self.pipeline.test(both.where(us >= ends[0] - keep), summary=False)[0]
        new = {n: s.on(s.df.where(us >= ends[0])) for n, s in results.items() if isinstance(s, Series)}
        self.sink(batch_id, new)
        for p, (end, b) in folders.items():
            if b == batch_id or end < ends[0] - reach:
                fs.delete(p, True)
        batch.write.mode("overwrite").parquet(f"{self.history}/end={ends[1]},batch={batch_id}")
        if any([c.evaluate(**(self.inputs(new, batch) if self.inputs and not isinstance(c, PeriodicCondition) else {})) for c in self.conditions]):
            self.pipeline.train(both.where(us <= ends[1] - self.lag), summary=False)
            self.refits.append(batch_id)
        batch.unpersist()


def windowed(stream: DataFrame, time: str, value: str, size: str, slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Event-time window aggregates with a watermark, for streams and tables alike."""
    out = stream.withWatermark(time, late) if stream.isStreaming else stream
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return out.groupBy(window.alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias(time), *keys, "n", "mean")
