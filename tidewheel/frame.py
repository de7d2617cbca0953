"""A series: one value column of a DataFrame with a time column and optional key columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from .errors import InputNotAvailable, InvalidInput
from .functions.windows import ordered


@dataclass(frozen=True)
class Series:
    df: DataFrame
    col: str
    time: str = "time"
    keys: tuple[str, ...] = ()

    @property
    def index(self) -> list[str]:
        return [*self.keys, self.time]

    @property
    def window(self) -> WindowSpec:
        return ordered(list(self.keys), self.time)

    @property
    def is_array(self) -> bool:
        return dict(self.df.dtypes)[self.col].startswith("array")

    def frame(self, name: str | None = None) -> DataFrame:
        return self.df.select(*self.index, F.col(self.col).alias(name or self.col))

    def with_value(self, value, name: str | None = None) -> Series:
        """The same rows with another value; the old column goes unless it is the named one."""
        name = name or self.col
        return replace(self, df=self.df.select(*self.index, value.alias(name)), col=name)

    def on(self, df: DataFrame, col: str | None = None) -> Series:
        return replace(self, df=df, col=col or self.col)


def ingest(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in floating columns: NULL is the one mark of a missing value."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def align(inputs: dict[str, Series], how: str = "inner") -> tuple[DataFrame, Series]:
    """All inputs in one frame, a column each by its name, joined on keys and time; inputs of one frame need no join."""
    if not inputs:
        raise InputNotAvailable("No input is given.", "Pass at least one series by keyword.")
    groups: dict[int, list[tuple[str, Series]]] = {}
    for name, s in inputs.items():
        groups.setdefault(id(s.df), []).append((name, s))
    first = next(iter(inputs.values()))
    out = None
    for members in groups.values():
        s = members[0][1]
        if s.index != first.index:
            raise InvalidInput("Inputs have different index columns.", f"{s.index} and {first.index}.")
        part = s.df.select(*s.index, *(F.col(m.col).alias(n) for n, m in members))
        out = part if out is None else out.join(part, first.index, how)
    return out, replace(first, df=out, col=next(iter(inputs)))
