"""Base classes of operators: parameters from the constructor, transform, fit, save and load, and wiring by call."""

from __future__ import annotations

import copy
import inspect
from typing import Any

from ..errors import WrongParameter


class Operator:
    has_inverse_transform = False
    has_predict_proba = False
    should_align = True
    min_data_in_time = False  # get_min_data is in microseconds

    def get_params(self, deep: bool = False) -> dict[str, Any]:
        names = [p for p in inspect.signature(type(self).__init__).parameters if p not in ("self", "args", "kwargs")]
        out = {n: getattr(self, n) for n in names}
        for n, v in list(out.items()):
            if deep and isinstance(v, Operator):
                out |= {f"{n}__{k}": x for k, x in v.get_params(True).items()}
        return out

    def set_params(self, **params: Any):
        known = self.get_params()
        for k, v in params.items():
            head, _, rest = k.partition("__")
            if head not in known:
                raise WrongParameter(f"{type(self).__name__} has no parameter {head!r}.", f"It has {sorted(known)}.")
            if rest:
                getattr(self, head).set_params(**{rest: v})
            else:
                known[head] = v
        rest = {k: v for k, v in known.items()}
        self.__init__(**rest)  # the constructor's checks run again
        return self

    def get_min_data(self) -> int:
        """History in rows (or microseconds for time ranges) that one new value needs."""
        return 0

    def clone(self):
        """A new operator with the same parameters and fitted values."""
        params = {k: v.clone() if isinstance(v, Operator) else v for k, v in self.get_params().items()}
        out = type(self)(**params)
        if getattr(self, "state", None) is not None:
            out.state = copy.deepcopy(self.state)
        if getattr(self, "model", None) is not None:
            out.model = self.model  # models of Spark ML don't change
        return out

    def __call__(self, **inputs: Any):
        from ..plans.pipeline import wire

        return wire(self, inputs)


class Estimator(Operator):
    """Has ``fit(**inputs)``: keywords that begin with ``target`` are targets. Fitted values are in ``state``, which is JSON."""

    state: dict | None = None

    def fit(self, **inputs):
        raise NotImplementedError


def split_inputs(inputs: dict) -> tuple[dict, dict]:
    """Inputs, and targets: those whose name begins with ``target``."""
    targets = {k: v for k, v in inputs.items() if k.startswith("target")}
    return {k: v for k, v in inputs.items() if k not in targets}, targets
