"""Window specifications over series: rows by position, ranges by time, and a row index without one big partition."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..errors import InvalidInput, WrongParameter

MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "t": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 7 * 86_400_000_000}


def span_micros(span: str) -> int:
    """Microseconds of a fixed span such as ``12h``, ``1800s`` or ``7D``."""
    m = re.fullmatch(r"\s*(\d*)\s*([a-zA-Z]+)\s*", span)
    if not m or m[2].lower() not in MICROS:
        raise WrongParameter(f"{span!r} is no fixed time span.", f"Use a number and one of {sorted(MICROS)}.")
    return int(m[1] or 1) * MICROS[m[2].lower()]


def micros(time: str = "time") -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def ordered(keys: list[str] | None = None, time: str = "time") -> WindowSpec:
    """All rows of a series in time order. Without keys Spark sorts in one task; give keys, or use ``bucketed``, for long series."""
    return Window.partitionBy(*(keys or [])).orderBy(time)


def time_range(size: int, closed: str = "left", keys: list | None = None, time: str = "time") -> WindowSpec:
    """A trailing frame of ``size`` microseconds; ``closed`` says which ends belong to it. Times are unique in a series."""
    bounds = {"left": (-size, -1), "right": (-(size - 1), 0), "both": (-size, 0), "neither": (-(size - 1), -1)}
    if closed not in bounds:
        raise WrongParameter(f"closed={closed!r} is unknown.", f"Use one of {sorted(bounds)}.")
    return Window.partitionBy(*(keys or [])).orderBy(micros(time)).rangeBetween(*bounds[closed])


def bucketed(df: DataFrame, size: int, bucket: int | None = None, time: str = "time") -> DataFrame:
    """Cut one long series into time buckets, each with the rows of the ``size`` microseconds before it.

    Adds ``_bucket`` (a partition key for time-range windows of at most
    ``size``) and ``_halo`` (rows to drop after the window was computed), so
    that an unkeyed window runs in as many tasks as there are buckets.
    """
    width = max(bucket or 0, size, 1)
    at = F.floor(micros(time) / width).cast("long")
    next_ = at + 1
    reaches = (next_ * width - micros(time)) <= size
    copies = F.when(reaches, F.array(at, next_)).otherwise(F.array(at))
    return df.withColumn("_own", at).withColumn("_bucket", F.explode(copies)).withColumn("_halo", ~F.col("_bucket").eqNullSafe(F.col("_own"))).drop("_own")


def row_index(df: DataFrame, time: str = "time", name: str = "rn", parts: int | None = None) -> DataFrame:
    """0-based position in time order, nulls first. No task holds the series.

    One job takes quantiles of the time column; as literals they cut it into
    parts that are the same wherever the plan is evaluated. Parts are counted,
    and rows numbered within each from its offset. Rows of one time are in one
    part, and get distinct numbers in an order that isn't defined.
    """
    parts = max(2, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = df.schema[time].dataType.simpleString()
    place = micros(time) if kind.startswith("timestamp") else F.unix_date(time) if kind == "date" else F.col(time)
    if kind.startswith(("timestamp", "date")) or kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        found = df.select(place.alias("_t")).agg(F.percentile_approx("_t", [k / parts for k in range(1, parts)], 100 * parts)).first()[0]
        part = F.when(place.isNull(), 0).otherwise(_rank(place, sorted(set(found or []))))
    else:
        raise InvalidInput(f"The time column is of type {kind}.", "Use a time, a date or a number.")
    ranged = df.withColumn("_part", part)
    counts = ranged.groupBy("_part").count()
    base = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", base.alias("_base"))  # a row a part
    local = F.row_number().over(Window.partitionBy("_part").orderBy(time)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(counts), "_part").withColumn(name, F.col("_base") + F.col("_local")).drop("_part", "_base", "_local")


def running_sum(df: DataFrame, value: str, name: str, rn: str = "rn", width: int = 100_000, own: bool = True) -> DataFrame:
    """Sum of a column over all rows up to each one (``own``: with it) by position: sums within blocks of ``width`` positions and those of the blocks before. No task holds the series."""
    block = df.withColumn("_block", F.floor(F.col(rn) / width).cast("long"))
    sums = block.groupBy("_block").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select("_block", before.alias("_before"))  # a row a block
    inner = F.sum(value).over(Window.partitionBy("_block").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    out = block.withColumn("_inner", F.coalesce(inner, F.lit(0.0))).join(sums, "_block")
    return out.withColumn(name, F.col("_before") + F.col("_inner")).drop("_block", "_inner", "_before")


def _rank(place: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most the place, by a tree of comparisons."""
    if not bounds:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:  # the answer lies in lo..hi
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(place < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))
