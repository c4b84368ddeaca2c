"""Runs (gaps and islands) and clusters over ordered rows, with window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: str, state: Column, least: int = 1, merge_gap: int = 0) -> DataFrame:
    """(keys, s, e) half-open runs of rows whose state holds; ``order`` holds consecutive integers.

    Runs shorter than ``least`` go; then runs with fewer than merge_gap rows between them become one."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = df.where(state).withColumn("__g", F.col(order) - F.row_number().over(w))
    found = on.groupBy(*keys, "__g").agg(F.min(order).alias("s"), (F.max(order) + 1).alias("e")).where(F.col("e") - F.col("s") >= least).drop("__g")
    if merge_gap < 1:
        return found
    by_start = Window.partitionBy(*keys).orderBy("s")
    starts = found.withColumn("__new", (F.col("s") - F.lag("e").over(by_start) >= merge_gap) | F.lag("e").over(by_start).isNull())
    groups = starts.withColumn("__g", F.sum(F.col("__new").cast("int")).over(by_start))
    return groups.groupBy(*keys, "__g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__g")


def _merged(found: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Runs (keys, n, s, e), whose ends grow with their starts, with those fewer than ``gap`` apart made one."""
    w = Window.partitionBy(*keys).orderBy("s")
    new = F.coalesce((F.col("s") - F.lag("e").over(w) >= gap).cast("int"), F.lit(1))
    groups = found.withColumn("__new", new).withColumn("__g", F.sum("__new").over(w))
    return groups.groupBy(*keys, "n", "__g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__g")


def _islands(df: DataFrame, keys: list[str], order: str, state) -> DataFrame:
    """(keys, n, s, e) runs of rows for which state(value, greatest value of the keys) holds; ``order`` counts from 0."""
    every = Window.partitionBy(*keys)
    marked = df.withColumn("n", F.count("*").over(every)).withColumn("__top", F.max("value").over(every)).where(state(F.col("value"), F.col("__top")))
    island = marked.withColumn("__g", F.col(order) - F.row_number().over(every.orderBy(order)))
    return island.groupBy(*keys, "n", "__g").agg(F.min(order).alias("s"), (F.max(order) + 1).alias("e")).drop("__g")


def row_runs(df: DataFrame, keys: list[str], order: str, limit: float = 0.9, least: int = 2, gap: int = 1) -> DataFrame:
    """(keys, n, s, e): lines of a cell, from (keys, order, value). Runs of rows below the limit, each taking one light row
    before it (from the third row on) and one after it. The signal is divided by its maximum if that is below 1."""
    found = _islands(df, keys, order, lambda v, top: F.when(top < 1, v / top).otherwise(v) < limit)
    wide = found.select(*keys, "n", F.when(F.col("s") > 2, F.col("s") - 1).otherwise(F.col("s")).alias("s"), F.least(F.col("e") + 1, F.col("n")).alias("e"))
    return _merged(wide.where(F.col("e") - F.col("s") >= least), keys, gap)


def column_runs(df: DataFrame, keys: list[str], order: str, limit: float = 0.01, least: int = 3, gap: int = 1) -> DataFrame:
    """(keys, n, s, e): words of a line. Runs of columns above the limit; the signal is divided by its maximum if that is
    above 1."""
    found = _islands(df, keys, order, lambda v, top: F.when(top > 1, v / top).otherwise(v) > limit)
    return _merged(found.where(F.col("e") - F.col("s") >= least), keys, gap)


def chained_clusters(df: DataFrame, keys: list[str], value: str, tie: list[str], tolerance: float, name: str = "cluster") -> DataFrame:
    """df with a group number: a new group where a value is more than the tolerance above the one before."""
    w = Window.partitionBy(*keys).orderBy(value, *tie)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(1))
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, k: int) -> Column:
    """Moving average of 2k+1 rows, with zeros beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, k)
    return F.sum(value).over(w) / (2 * k + 1)


def extrema(keys: list[str], order: str, value: str) -> tuple[Column, Column]:
    """(is a peak, is a valley): above (below) the row before and not below (above) the next."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.coalesce((x > before) & (x >= after), F.lit(False)), F.coalesce((x < before) & (x <= after), F.lit(False))


def trimmed_groups(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first rows of every group, as many as the smallest group has."""
    sizes = df.groupBy(group).count().agg(F.min("count").alias("__least"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__place", place).join(F.broadcast(sizes), F.col("__place") <= F.col("__least"), "left_semi").drop("__place")
