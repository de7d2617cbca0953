"""Lazy workflow graphs: steps are wired by call, compiled to DataFrame plans, trained, tested, saved and loaded."""

from __future__ import annotations

import importlib
import inspect
import json
import logging
import os
import shutil
import time
from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputNotAvailable, StepCreation, WrongParameter
from ..frame import Series, align, ingest
from ..functions.windows import micros, span_micros
from ..operators.base import Estimator, Operator
from ..operators.preprocessing import either

log = logging.getLogger("tidewheel")


class Mode(Enum):
    """What a step does in training and testing."""

    DEFAULT = "default"
    TRAIN = "train"
    TRANSFORM = "transform"
    FIT_TRANSFORM = "fit_transform"
    REFIT = "refit"


@dataclass
class Step:
    pipeline: Pipeline
    name: str
    module: Any = None
    inputs: dict[str, Any] = field(default_factory=dict)
    method: str = "transform"
    mode: Mode = Mode.DEFAULT
    condition: Any = None
    callbacks: list = field(default_factory=list)
    refit_conditions: list = field(default_factory=list)
    lag: Any = None
    item: str | None = None
    buffer: Any = None
    seconds: float = 0.0
    refits: int = 0

    def __getitem__(self, key: str) -> Step:
        """One of several results."""
        return self.pipeline.add(Step(self.pipeline, f"{self.name}.{key}", inputs={"of": self}, item=key), unique=False)


def wire(module: Operator, inputs: dict[str, Any]) -> Step:
    options = {k: inputs.pop(k) for k in ("callbacks", "condition", "mode", "method", "refit_conditions", "lag") if k in inputs}
    steps = [s for v in inputs.values() for s in (v if isinstance(v, tuple) else (v,))]
    if not steps or not all(isinstance(s, Step) for s in steps):
        raise StepCreation(f"{getattr(module, 'name', module)} has inputs that aren't steps.", "Pass steps by keyword.")
    pipeline = steps[0].pipeline
    if any(s.pipeline is not pipeline for s in steps):
        raise StepCreation("Inputs belong to different pipelines.", "Use one.")
    method = options.get("method", "transform")
    if method == "inverse_transform" and not module.has_inverse_transform:
        raise StepCreation(f"{module.name} has no inverse.", "Use another module.")
    if method == "predict_proba" and not module.has_predict_proba:
        raise StepCreation(f"{module.name} has no probabilities.", "Use another module.")
    if "lag" in options:
        lag = options["lag"]
        options["lag"] = span_micros(lag) if isinstance(lag, str) else int(lag.total_seconds() * 1e6)
    if options.get("refit_conditions") and options.get("mode") is not Mode.REFIT:
        raise StepCreation(f"{module.name} has refit conditions.", "Its mode must be Mode.REFIT.")
    return pipeline.add(Step(pipeline, module.name, module, inputs, **options))


def wire_condition(condition, inputs: dict[str, Step]) -> None:
    """Give a refit condition its inputs, which must be what its ``evaluate`` takes."""
    needed = [p for p in inspect.signature(condition.evaluate).parameters]
    if set(needed) != set(inputs):
        raise StepCreation(f"The condition {condition.name} takes {needed}.", f"It got {sorted(inputs)}.")
    condition.inputs = dict(inputs)


class Pipeline(Operator):
    """A graph over the columns of one table; also a module of other pipelines.

    ``batch`` (a fixed time span, for pipelines that are modules): outside of
    training, steps see one span after the other, each with all before it.
    """

    has_inverse_transform = False

    def __init__(self, path: str | None = None, batch: str | None = None, keys: tuple[str, ...] = (), time_column: str = "time", name: str = "Pipeline") -> None:
        self.path, self.batch, self.keys, self.time_column, self.name = path, batch, tuple(keys), time_column, name
        self.steps: dict[str, Step] = {}
        self._past: DataFrame | None = None
        if batch is not None:
            span_micros(batch)

    def __getitem__(self, column: str) -> Step:
        if column not in self.steps:
            self.add(Step(self, column))
        return self.steps[column]

    def add(self, step: Step, unique: bool = True) -> Step:
        if not unique and step.name in self.steps:
            return self.steps[step.name]
        base, k = step.name, 1
        while step.name in self.steps:
            step.name = f"{base}_{k}"
            k += 1
        if step.name != base:
            log.warning("a step %s is there already; this one is %s", base, step.name)
        self.steps[step.name] = step
        return step

    def train(self, data: DataFrame, summary: bool = True):
        self._past = None
        return self._run(data, True, summary)

    def test(self, data: DataFrame, reset: bool = True, summary: bool = True, refit: bool = False):
        """Results of the rows of ``data``. Without ``reset`` the rows of earlier calls come before them, as history of windows and lags, and buffers grow.

        With ``refit`` the conditions of steps in ``Mode.REFIT`` are asked when all steps are done, and a
        step of which one holds is fitted anew to all rows so far, but for those newer than its ``lag``.
        """
        if reset:
            self._past = None
        first = data.agg(F.min(micros(self.time_column))).first()[0] if self._past is not None else None
        both = data if self._past is None else self._past.unionByName(data)
        out = self._run(both, False, summary, first, refit)
        self._past = None if reset else both
        return out

    def need(self) -> tuple[int, int]:
        """History that one new value needs, in rows and in microseconds: the most of any path through the graph."""
        most: dict[str, tuple[int, int]] = {}
        for name, step in self.steps.items():
            before = [most[x.name] for v in step.inputs.values() for x in (v if isinstance(v, tuple) else (v,))]
            rows, time_ = max((b[0] for b in before), default=0), max((b[1] for b in before), default=0)
            if isinstance(step.module, Pipeline):
                own = step.module.need()
                rows, time_ = rows + own[0], time_ + own[1]
            elif step.module is not None:
                n = step.module.get_min_data()
                rows, time_ = (rows, time_ + n) if step.module.min_data_in_time else (rows + n, time_)
            most[name] = (rows, time_)
        return max((m[0] for m in most.values()), default=0), max((m[1] for m in most.values()), default=0)

    def get_min_data(self) -> int:
        return self.need()[0]

    def fit(self, **inputs: Series) -> Pipeline:
        """As a module: train its own steps."""
        df, s = align(inputs)
        self.time_column, self.keys = s.time, s.keys
        self._run(df, True, False)
        return self

    def transform(self, **inputs: Series):
        """As a module: inputs by column name, results of the last steps."""
        df, s = align(inputs)
        self.time_column, self.keys = s.time, s.keys
        if self.batch is None:
            out = self._run(df, False, False)[0]
        else:
            us, width = micros(s.time), span_micros(self.batch)
            ends, out = df.agg(F.min(us), F.max(us)).first(), {}
            for start in range(ends[0], ends[1] + 1, width) if ends[0] is not None else []:
                part = self._run(df.where(us < start + width), False, False, start)[0]
                out = {n: x if n not in out else x.on(out[n].df.unionByName(x.df)) for n, x in part.items()}
        return out if len(out) > 1 else next(iter(out.values()))

    def _run(self, data: DataFrame, training: bool, summary: bool, first: int | None = None, refit: bool = False):
        data = ingest(data)
        done: dict[str, Any] = {}
        used = set()
        recent = lambda x: x.on(x.df.where(micros(x.time) >= first)) if first is not None and isinstance(x, Series) else x
        for name, step in self.steps.items():  # in the order of wiring, which is topological
            done[name] = self._step(step, data, done, training)
            log.info("%s %s%s", "trained" if training else "ran", name, "" if done[name] is not None else " (left out)")
            new = {k: recent(v) for k, v in done[name].items()} if isinstance(done[name], dict) else recent(done[name])
            step.buffer = new if first is None else _appended(step.buffer, new)
            used |= {s.name for v in step.inputs.values() for s in (v if isinstance(v, tuple) else (v,))}
            for c in step.callbacks:
                if new is not None:
                    c(new if isinstance(new, dict) else {name: new})
        if refit:
            self._refit(data, done, recent)
        leaves = {n: recent(v) for n, v in done.items() if n not in used and v is not None}
        tables = {n: v for n, v in leaves.items() if isinstance(v, DataFrame)}
        text = self.write_summary(tables) if summary else ""
        return {n: v for n, v in leaves.items() if n not in tables}, text, tables

    def _refit(self, data: DataFrame, done: dict, recent) -> None:
        """Conditions see the new rows; fits see all but those within the lag."""
        end = data.agg(F.max(micros(self.time_column))).first()[0]
        for step in self.steps.values():
            if step.mode is not Mode.REFIT or not step.refit_conditions or done[step.name] is None:
                continue
            held = [c.evaluate(**{k: recent(done[x.name]) for k, x in (getattr(c, "inputs", None) or {}).items()}) for c in step.refit_conditions]
            if any(held):
                old = lambda x, by=end - (step.lag or 0): x.on(x.df.where(micros(x.time) <= by))
                step.module.fit(**{k: old(v) for k, v in self._inputs(step, done).items()})
                step.refits += 1
                log.info("fitted %s anew", step.name)

    def create_summary(self) -> str:
        """The summary of what the steps gave last."""
        return self.write_summary({n: s.buffer for n, s in self.steps.items() if isinstance(s.buffer, DataFrame)})

    def _inputs(self, step: Step, done: dict) -> dict[str, Any]:
        get = lambda v: done[v.name]
        inputs = {}
        for k, v in step.inputs.items():
            if isinstance(v, tuple):
                there = [get(s) for s in v if get(s) is not None]
                inputs[k] = None if not there else either(*there) if len(there) > 1 else there[0]
            else:
                inputs[k] = get(v)
        return inputs

    def _step(self, step: Step, data: DataFrame, done: dict, training: bool):
        if step.module is None and step.item is None:
            if step.name not in data.columns:
                raise InputNotAvailable(f"The data has no column {step.name!r}.", f"It has {data.columns}.")
            return Series(data, step.name, self.time_column, self.keys)
        inputs = self._inputs(step, done)
        if any(v is None for v in inputs.values()):
            return None
        if step.item is not None:
            return inputs["of"][step.item] if isinstance(inputs["of"], dict) else inputs["of"]
        if step.condition is not None and not step.condition(**{k: v for k, v in inputs.items() if k in inspect.signature(step.condition).parameters}):
            return None
        began = time.time()
        fits = isinstance(step.module, (Estimator, Pipeline)) and step.mode is not Mode.TRANSFORM and step.method == "transform"
        if fits and (training or step.mode is Mode.FIT_TRANSFORM):
            step.module.fit(**inputs)
            step.seconds = time.time() - began
        if step.mode is Mode.TRAIN and not training:
            return None
        given = inputs
        if isinstance(step.module, Estimator) and not training:
            names = inspect.signature(step.module.transform).parameters
            open_ = any(p.kind is p.VAR_KEYWORD for p in names.values())
            given = {k: v for k, v in inputs.items() if open_ or k in names}
        return getattr(step.module, step.method)(**given)

    def write_summary(self, tables: dict[str, DataFrame]) -> str:
        """Metrics and fit times as Markdown, also to ``summary.md`` in a run folder where the pipeline has a path."""
        lines = ["# Summary"]
        for n, df in tables.items():
            lines.append(f"## {n}")
            lines += [" | ".join(str(v) for v in r) for r in [df.columns, *_rows(df)]]
        lines.append("## Fit seconds")
        lines += [f"{s.name} | {s.seconds:.3f}" for s in self.steps.values() if isinstance(s.module, Estimator)]
        text = "\n".join(lines) + "\n"
        if self.path:
            with open(self.get_path("summary.md"), "w") as f:
                f.write(text)
        return text

    def get_path(self, name: str) -> str:
        """A path in this run's folder, which has the time of its first use in its name."""
        if not self.path:
            raise WrongParameter("The pipeline has no path.", "Give it one.")
        if not hasattr(self, "_run_folder"):
            self._run_folder = os.path.join(self.path, datetime.now().strftime("run_%Y%m%d_%H%M%S_%f"))
            os.makedirs(self._run_folder)
        return os.path.join(self._run_folder, name)

    def clone(self) -> Pipeline:
        """The same graph with copies of its modules."""
        out = type(self)(self.path, self.batch, self.keys, self.time_column, self.name)
        copies: dict[int, Any] = {}
        for s in self.steps.values():
            if s.module is not None and id(s.module) not in copies:
                copies[id(s.module)] = s.module.clone()
            wires = {k: tuple(out.steps[x.name] for x in v) if isinstance(v, tuple) else out.steps[v.name] for k, v in s.inputs.items()}
            out.add(Step(out, s.name, copies.get(id(s.module)), wires, s.method, s.mode, s.condition, list(s.callbacks), list(s.refit_conditions), s.lag, s.item))
        return out

    def to_folder(self, path: str) -> None:
        """The graph as JSON, modules with their fitted values, models of Spark ML in folders, and functions pickled."""
        os.makedirs(path, exist_ok=True)
        store = _Store(path)
        steps = []
        for s in self.steps.values():
            wires = {k: [x.name for x in v] if isinstance(v, tuple) else v.name for k, v in s.inputs.items()}
            conditions = [{"at": store.put(c), "inputs": {k: x.name for k, x in (getattr(c, "inputs", None) or {}).items()}} for c in s.refit_conditions]
            steps.append({
                "name": s.name, "module": store.put(s.module), "inputs": wires, "method": s.method, "mode": s.mode.value, "item": s.item, "lag": s.lag,
                "condition": store.put(s.condition), "callbacks": [store.put(c) for c in s.callbacks], "refit_conditions": conditions,
            })
        with open(os.path.join(path, "pipeline.json"), "w") as f:
            json.dump({"keys": self.keys, "time": self.time_column, "batch": self.batch, "path": self.path, "name": self.name, "objects": store.saved, "steps": steps}, f)

    @classmethod
    def from_folder(cls, path: str) -> Pipeline:
        """What ``to_folder`` wrote. Functions are unpickled, so load only folders you trust."""
        with open(os.path.join(path, "pipeline.json")) as f:
            d = json.load(f)
        out = cls(d["path"], d["batch"], tuple(d["keys"]), d["time"], d["name"])
        objects = [_load(o, path) for o in d["objects"]]
        at = lambda k: None if k is None else objects[k]
        for s in d["steps"]:
            wires = {k: tuple(out.steps[x] for x in v) if isinstance(v, list) else out.steps[v] for k, v in s["inputs"].items()}
            step = Step(out, s["name"], at(s["module"]), wires, s["method"], Mode(s["mode"]), at(s["condition"]), [at(k) for k in s["callbacks"]], [at(c["at"]) for c in s["refit_conditions"]], s["lag"], s["item"])
            out.add(step)
        for s in d["steps"]:  # conditions may be wired to later steps
            for c in s["refit_conditions"]:
                objects[c["at"]].inputs = {k: out.steps[x] for k, x in c["inputs"].items()}
        return out


def _rows(df: DataFrame):
    """Rows of a metric's table, one after the other."""
    return df.toLocalIterator()


def _appended(old, new):
    if isinstance(new, dict):
        return {k: _appended(old.get(k) if isinstance(old, dict) else None, v) for k, v in new.items()}
    if isinstance(new, Series) and isinstance(old, Series):
        return new.on(old.df.unionByName(new.df))
    return old if new is None else new


class _Store:
    """Objects of a graph, each saved once."""

    def __init__(self, path: str) -> None:
        self.path, self.saved, self.seen = path, [], []

    def put(self, x) -> int | None:
        if x is None:
            return None
        for k, y in enumerate(self.seen):
            if y is x:
                return k
        k = len(self.seen)
        self.seen.append(x)
        self.saved.append(None)
        name = f"object_{k}"
        where = os.path.join(self.path, name)
        shutil.rmtree(where, ignore_errors=True)
        if isinstance(x, Pipeline):
            x.to_folder(where)
            self.saved[k] = {"pipeline": name}
        elif isinstance(x, Operator) and hasattr(x, "save_model"):
            x.save_model(where)
            self.saved[k] = {"class": f"{type(x).__module__}:{type(x).__name__}", "model": name}
        elif isinstance(x, Operator) and type(x).__module__.startswith(__name__.split(".")[0] + ".") and _plain(x.get_params()):
            self.saved[k] = {"class": f"{type(x).__module__}:{type(x).__name__}", "params": x.get_params(), "state": getattr(x, "state", None)}
        else:  # functions, conditions, callbacks and modules of the user
            inputs, x_inputs = getattr(x, "inputs", None), hasattr(x, "inputs")
            if x_inputs:
                x.inputs = None  # steps are saved by name
            try:
                with open(where, "wb") as f:
                    cloudpickle.dump(x, f)
            finally:
                if x_inputs:
                    x.inputs = inputs
            self.saved[k] = {"pickle": name}
        return k


def _plain(params: dict) -> bool:
    try:
        return json.loads(json.dumps(params)) == params
    except TypeError:
        return False


def _load(saved: dict, path: str):
    if "pipeline" in saved:
        return Pipeline.from_folder(os.path.join(path, saved["pipeline"]))
    if "pickle" in saved:
        with open(os.path.join(path, saved["pickle"]), "rb") as f:
            return cloudpickle.load(f)
    where, name = saved["class"].split(":")
    if not where.startswith(__name__.split(".")[0] + "."):
        raise WrongParameter(f"{where} is no module of this library.", "Only such are loaded.")
    kind = getattr(importlib.import_module(where), name)
    if "model" in saved:
        return kind.load_model(os.path.join(path, saved["model"]))
    made = kind(**saved["params"])
    if saved["state"] is not None:
        made.state = saved["state"]
    return made
