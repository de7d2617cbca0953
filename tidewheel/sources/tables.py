"""Sources and sinks: readers with a schema, splits, and callbacks that write a step's results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Series, ingest
from ..functions.windows import row_index


def read_csv(spark: SparkSession, path: str, schema: str, time_format: str | None = None, **options) -> DataFrame:
    """CSV with a header and a given schema; nothing is inferred."""
    if time_format:
        options["timestampFormat"] = time_format
    return ingest(spark.read.csv(path, schema=schema, header=True, **options))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return ingest(spark.read.parquet(path))


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """A pandas frame whose index is the time."""
    out = frame.reset_index()
    return ingest(spark.createDataFrame(out.rename(columns={out.columns[0]: "time"})))


def split_rows(df: DataFrame, n: int, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """The first n rows in time order, and the rest."""
    numbered = row_index(df, time, "_rn")
    return tuple(numbered.where(c).drop("_rn") for c in (F.col("_rn") < n, F.col("_rn") >= n))


class Callback:
    """Called with the results of a step by name. Paths come from ``folder``, a function of a name or a path."""

    def __init__(self, prefix: str = "", folder=".") -> None:
        self.prefix, self.folder = prefix, folder

    def path(self, name: str) -> str:
        return self.folder(name) if callable(self.folder) else os.path.join(self.folder, name)

    def each(self, key: str, x: Series) -> None:
        raise NotImplementedError

    def __call__(self, results: dict[str, Series]) -> None:
        for k, x in results.items():
            self.each(k, x)


class CSVCallback(Callback):
    """A folder of CSV parts per result, written in parallel; arrays are JSON."""

    def each(self, key: str, x: Series) -> None:
        value = F.to_json(x.col) if x.is_array else F.col(x.col)
        x.df.select(*x.index, value.alias(x.col)).write.mode("overwrite").csv(self.path(f"{self.prefix}_{key}.csv"), header=True)


class ParquetCallback(Callback):
    def each(self, key: str, x: Series) -> None:
        x.frame().write.mode("overwrite").parquet(self.path(f"{self.prefix}_{key}.parquet"))


class NPYCallback(Callback):
    """Values in time order as ``.npy``: for results that fit the driver."""

    def each(self, key: str, x: Series) -> None:
        import numpy as np

        np.save(self.path(f"{self.prefix}_{key}.npy"), np.array([r[0] for r in x.df.orderBy(*x.index).select(x.col).collect()]))


class PrintCallback(Callback):
    def each(self, key: str, x: Series) -> None:
        print(key)
        x.df.orderBy(*x.index).show()


class StatisticCallback(Callback):
    """Count, mean, deviation, ends and exact quartiles, printed and written as Markdown."""

    def table(self, x: Series) -> DataFrame:
        v = F.col(x.col).cast("double")
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return x.df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q[0].alias("25%"), q[1].alias("50%"), q[2].alias("75%"), F.max(v).alias("max"))

    def each(self, key: str, x: Series) -> None:
        row = self.table(x).first().asDict()
        text = f"# {key}\n" + "\n".join(f"{k} | {v}" for k, v in row.items()) + "\n"
        print(text)
        with open(self.path(f"{self.prefix}_Statistics.md"), "w") as f:
            f.write(text)


class LinePlotCallback(Callback):
    """A line plot; needs matplotlib, and thins long series to ``most`` points."""

    def __init__(self, prefix: str = "", folder=".", most: int = 5000) -> None:
        super().__init__(prefix, folder)
        self.most = most

    def each(self, key: str, x: Series) -> None:
        try:
            import matplotlib.pyplot as plt
        except ImportError as e:
            raise RuntimeError("Plots need matplotlib.") from e
        n = x.df.count()
        step = max(1, n // self.most)
        rows = row_index(x.frame(), x.time, "_rn").where(F.col("_rn") % step == 0).orderBy(x.time).toPandas()
        plt.figure()
        if x.is_array:
            plt.imshow(list(zip(*rows[x.col])), aspect="auto")
        else:
            plt.plot(rows[x.time], rows[x.col])
        plt.savefig(self.path(f"{self.prefix}_{key}.png"))
        plt.close()


class ImagePlotCallback(LinePlotCallback):
    """An image of array results only."""

    def each(self, key: str, x: Series) -> None:
        if x.is_array:
            super().each(key, x)
