"""Nearest-match, band and overlap joins, rewritten to equi-joins on buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, tolerance: float, how: str = "inner") -> DataFrame:
    """Pairs with equal keys and |x - y| <= tolerance. Each right row goes to its bucket, each left row asks three."""
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    a = left.withColumn("__b", F.explode(F.array(*(bucket(x) + d for d in (-1, 0, 1)))))
    b = right.withColumn("__b", bucket(y))
    return a.join(b, [*keys, "__b"], how).where(F.abs(F.col(x) - F.col(y)) <= tolerance).drop("__b")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Each left row's nearest right row within the tolerance; the smaller right id among equals."""
    best = F.min(F.struct(F.abs(F.col(x) - F.col(y)).alias("d"), F.col(right_id).alias("id")))
    return band_join(left, right, keys, x, y, tolerance).groupBy(*keys, left_id).agg(best.alias("m")).select(*keys, left_id, F.col("m.id").alias(right_id), F.col("m.d").alias("distance"))


def first_after(df: DataFrame, keys: list[str], order: list[str], matches: Column, name: str, value: str) -> DataFrame:
    """df with the value of the first later row (in order) for which ``matches`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.first(F.when(matches, F.col(value)), ignorenulls=True).over(w))


def overlapping(df: DataFrame, keys: list[str], ident: str, s: str, e: str, share: float, bucket: float) -> DataFrame:
    """Pairs a < b (columns a_* and b_* of all but the keys) of intervals [s, e) whose overlap is at least ``share`` of the
    shorter. An interval goes to each bucket that it touches; a pair is kept in the one where its overlap begins, so no
    task holds all pairs of a key."""
    rest = [c for c in df.columns if c not in keys]
    dealt = df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))))
    a = dealt.select(*keys, "__b", *(F.col(c).alias(f"a_{c}") for c in rest))
    b = dealt.select(*keys, "__b", *(F.col(c).alias(f"b_{c}") for c in rest))
    begin, end = F.greatest(f"a_{s}", f"b_{s}"), F.least(f"a_{e}", f"b_{e}")
    shorter = F.least(F.col(f"a_{e}") - F.col(f"a_{s}"), F.col(f"b_{e}") - F.col(f"b_{s}"))
    found = a.join(b, [*keys, "__b"]).where((F.col(f"a_{ident}") < F.col(f"b_{ident}")) & (F.floor(begin / bucket) == F.col("__b")))
    return found.where((shorter > 0) & (F.greatest(end - begin, F.lit(0)) >= share * shorter)).drop("__b")


def same_line(df: DataFrame, key: str, ident: str, bucket: float, share: float = 0.45, widths: float = 1.5) -> DataFrame:
    """(key, a, b): components (x, y, w, h) of one key that stand on one line: heights overlap by ``share`` of the lower one,
    and the gap between them is at most ``widths`` of the key's median width (10 where that is below 1)."""
    median = df.groupBy(key).agg(F.median("w").alias("m")).select(key, F.when(F.col("m") < 1, 10.0).otherwise(F.col("m")).alias("__m"))
    boxes = df.select(key, ident, "x", "w", F.col("y").alias("s"), (F.col("y") + F.col("h")).alias("e"))
    found = overlapping(boxes, [key], ident, "s", "e", share, bucket).join(median, key)
    gap = F.when(F.col("a_x") <= F.col("b_x"), F.col("b_x") - F.col("a_x") - F.col("a_w")).otherwise(F.col("a_x") - F.col("b_x") - F.col("b_w"))
    return found.where(gap <= widths * F.col("__m")).select(key, F.col(f"a_{ident}").alias("a"), F.col(f"b_{ident}").alias("b"))


def group_components(nodes: DataFrame, edges: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, ident, component), the least ident that a node reaches, for graphs that lie within one key each; idents are
    longs and differ between keys. A partition's keys come in order, and an Arrow batch's graphs are labelled together."""
    both = nodes.select(F.col(key).cast("long").alias(key), F.col(ident).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    both = both.unionByName(edges.select(F.col(key).cast("long").alias(key), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))

    def label(table):
        ends = table.column("b").fill_null(pc.min(table.column("a"))).to_numpy()
        linked = table.column("b").is_valid().to_numpy()
        a = table.column("a").to_numpy()
        ids, place = np.unique(a, return_inverse=True)
        x, y = place[linked], np.searchsorted(ids, ends[linked])
        least = np.arange(len(ids))
        while len(x):
            low = np.minimum(least[x], least[y])
            new = least.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = np.minimum(new, new[new])
            if np.array_equal(new, least):
                break
            least = new
        keys = np.empty(len(ids), np.int64)
        keys[place] = table.column(key).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(ids[least])], names=[key, ident, "component"])

    def run(batches):
        held = None  # the rows of the last key so far, which may go on
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            values = table.column(key).to_numpy()
            cut = int(np.searchsorted(values, values[-1], "left"))
            if cut:
                yield label(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield label(held)

    return both.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} long, {ident} long, component long")


def first_row_below(cells: DataFrame, nodes: DataFrame, key: str, ident: str, tolerance: float) -> DataFrame:
    """(key, ident, below): for cells (key, ident, r, x1, x2) the first row of nodes (key, r, x) under r with a node within
    the tolerance of x1 and one within it of x2; null if no row has both."""

    def near(corner):
        found = band_join(cells.select(key, ident, F.col("r").alias("__r"), corner), nodes.select(key, "r", "x"), [key], corner, "x", tolerance)
        return found.where(F.col("r") > F.col("__r")).select(key, ident, "r").distinct()

    both = near("x1").join(near("x2"), [key, ident, "r"]).groupBy(key, ident).agg(F.min("r").alias("below"))
    return cells.select(key, ident).join(both, [key, ident], "left")
