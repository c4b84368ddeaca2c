"""1-D signals as arrays: profiles, folds over runs, smoothing, peaks, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def variance(a: Column) -> Column:
    """Population variance."""
    return F.try_divide(total(F.transform(a, lambda x: (x - mean(a)) * (x - mean(a)))), F.size(a))


def column_profile(pixels: Column, height: int, width: int) -> Column:
    """Mean of each column of a row-major raster."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(height - 1)), F.lit(0.0), lambda s, i: s + F.get(pixels, i * width + j)) / height)


def row_profile(pixels: Column, height: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0.0), lambda s, j: s + F.get(pixels, i * width + j)) / width)


def run_score(states: Column) -> Column:
    """struct(score, longest) of an array of booleans: a run adds its length when it ends, an off state that ends none takes one away."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("score"), F.lit(0).alias("longest"))

    def step(a, on):
        return F.when(on, F.struct((a["run"] + 1).alias("run"), a["score"].alias("score"), F.greatest(a["longest"], a["run"] + 1).alias("longest"))).otherwise(
            F.struct(F.lit(0).alias("run"), (a["score"] + F.when(a["run"] > 0, a["run"]).otherwise(-1)).alias("score"), a["longest"].alias("longest"))
        )

    return F.aggregate(states, zero, step, lambda a: F.struct((a["score"] + a["run"]).alias("score"), a["longest"].alias("longest")))


def anchored_clusters(sorted_values: Column, tolerance: float) -> Column:
    """Array of struct(x, g): a new group where a value is more than the tolerance from its group's first."""
    return _clusters(sorted_values, tolerance, lambda a, x: a["anchor"])


def running_mean_clusters(sorted_values: Column, tolerance: float) -> Column:
    """Array of struct(x, g): a new group where a value is more than the tolerance from its group's mean so far."""
    return _clusters(sorted_values, tolerance, lambda a, x: (a["anchor"] * a["n"] + x) / (a["n"] + 1))


def _clusters(values, tolerance, moved):
    empty = F.array().cast("array<struct<x:double,g:int>>")
    zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0.0).alias("n"), F.lit(0).alias("g"), empty.alias("out"))

    def step(a, x):
        new = a["anchor"].isNull() | (F.abs(x - a["anchor"]) > tolerance)
        g = F.when(new, a["g"] + 1).otherwise(a["g"])
        return F.struct(F.when(new, x).otherwise(moved(a, x)).alias("anchor"), F.when(new, F.lit(1.0)).otherwise(a["n"] + 1).alias("n"), g.alias("g"), F.concat(a["out"], F.array(F.struct(x.alias("x"), g.alias("g")))).alias("out"))

    return F.aggregate(values, zero, step, lambda a: a["out"])


def argmax(scores: Column) -> Column:
    """0-based place of the first greatest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def top_classes(scores: Column, n: int = 3) -> Column:
    """Classes of the n greatest scores, the smaller class first among equals."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("c")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: p["c"])


def fluctuation(a: Column) -> Column:
    """mean |difference| / (mean |x| + 1e-9)."""
    d = F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.abs(F.get(a, i) - F.get(a, i - 1)))
    return mean(d) / (mean(F.transform(a, F.abs)) + 1e-9)


def intervals(states: Column) -> Column:
    """Array of struct(s, e): the half-open runs of true in an array of booleans."""
    on = lambda i: F.coalesce(F.get(states, i), F.lit(False))
    at = F.sequence(F.lit(0), F.size(states))
    starts, ends = F.filter(at, lambda i: on(i) & ~on(i - 1)), F.filter(at, lambda i: on(i - 1) & ~on(i))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def valley_depth(profile: Column) -> Column:
    """Mean depth of a profile's valleys below the lower of the peaks next to them, the profile's range being 1.

    A flat profile has 0, one with fewer than two peaks or no valley its range over its maximum; 1 where no valley lies between peaks."""
    hi, lo = F.array_max(profile), F.array_min(profile)
    x = lambda i: (F.get(profile, i) - lo) / (hi - lo + 1e-12)
    c, inner = lambda i: F.get(profile, i), F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(profile) - 2))
    peaks = F.filter(inner, lambda i: (c(i) > c(i - 1)) & (c(i) >= c(i + 1)))
    valleys = F.filter(inner, lambda i: (c(i) < c(i - 1)) & (c(i) <= c(i + 1)))
    last, first = lambda k: F.array_max(F.filter(peaks, lambda p: p < k)), lambda k: F.array_min(F.filter(peaks, lambda p: p > k))
    depths = F.filter(F.transform(valleys, lambda k: F.when(last(k).isNotNull() & first(k).isNotNull(), F.least(x(last(k)), x(first(k))) - x(k))), lambda v: v > 0)
    few = (F.size(peaks) < 2) | (F.size(valleys) == 0)
    return F.when(hi - lo <= 1e-8, 0.0).when(few, (hi - lo) / (hi + 1e-9)).otherwise(F.coalesce(mean(depths), F.lit(1.0)))


def long_runs(states: Column, least: int) -> Column:
    """The runs of true that have ``least`` elements."""
    return F.filter(intervals(states), lambda r: r["e"] - r["s"] >= least)


def _grown(s: Column, e: Column, n: Column, removed: Column) -> tuple[Column, Column]:
    return F.when(s > removed, s - removed).otherwise(s), F.when(n - e >= 2, e + 2).when(n - e >= 1, e + 1).otherwise(e)


def grown_word(s: Column, e: Column, n: Column, removed: Column) -> Column:
    """struct(s, e) of a word's columns: moved by the removed rows, two more at the end, two again if narrow; null below 3."""
    s, e = _grown(s, e, n, removed)
    e = F.when((e - s <= 7) & (n - e >= 2), e + 2).otherwise(e)
    return F.when(e - s >= 3, F.struct(s.alias("s"), e.alias("e")))


def grown_blob(s: Column, e: Column, n: Column, removed: Column) -> Column:
    """The same of a line's rows: null below 5, two more at the end if just 5."""
    s, e = _grown(s, e, n, removed)
    return F.when(e - s >= 5, F.struct(s.alias("s"), F.when((e - s <= 5) & (n - e >= 2), e + 2).otherwise(e).alias("e")))


def moving_average(a: Column, k: int) -> Column:
    """Same length, zeros beyond the ends."""
    half = k // 2
    return F.transform(a, lambda _, i: sum((F.coalesce(F.get(a, i + d), F.lit(0.0)) for d in range(-half, half + 1)), F.lit(0.0)) / k)


def valley_counts(profile: Column, deep: float) -> Column:
    """struct(peaks, valleys, deep, deep_ratio, mean_depth, mean_deep, profile_range) of a profile whose range is made 1.

    A valley without a peak on either side has no depth; a profile that is flat or has fewer than 3 values has zeros."""
    lo, first = F.array_min(profile), F.get(profile, F.lit(0))
    flat = (F.size(profile) < 3) | F.forall(profile, lambda x: F.abs(x - first) <= 1e-8 + 1e-5 * F.abs(first))
    span = F.when(F.array_max(profile) - lo > 1e-9, F.array_max(profile) - lo).otherwise(1.0)
    x = lambda i: (F.get(profile, i) - lo) / span
    inner = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(profile) - 2))
    peaks = F.filter(inner, lambda i: (x(i) > x(i - 1)) & (x(i) >= x(i + 1)))
    valleys = F.filter(inner, lambda i: (x(i) < x(i - 1)) & (x(i) <= x(i + 1)))
    left, right = lambda v: F.array_max(F.filter(peaks, lambda p: p < v)), lambda v: F.array_min(F.filter(peaks, lambda p: p > v))
    depths = F.filter(F.transform(valleys, lambda v: F.when(left(v).isNotNull() & right(v).isNotNull(), F.greatest(F.least(x(left(v)), x(right(v))) - x(v), F.lit(0.0)))), lambda q: q.isNotNull())
    deeper = F.filter(depths, lambda q: q >= deep)
    size = lambda a: F.size(a).cast("long")
    fields = {"peaks": size(peaks), "valleys": size(valleys), "deep": size(deeper), "deep_ratio": F.size(deeper) / F.greatest(F.size(peaks), F.lit(1)), "mean_depth": F.coalesce(mean(depths), F.lit(0.0)), "mean_deep": F.coalesce(mean(deeper), F.lit(0.0)), "profile_range": span}
    return F.struct(*(F.when(flat, 0).otherwise(c).alias(n) for n, c in fields.items()))


def histogram_entropy(a: Column, bins: int) -> Column:
    """Entropy of a histogram over [0, 1], over that of equal bins; values outside are dropped, null if all are."""
    kept = F.transform(F.filter(a, lambda x: x.between(0, 1)), lambda x: F.least(F.floor(x * bins), F.lit(bins - 1)))
    shares = F.transform(F.array_distinct(kept), lambda b: F.size(F.filter(kept, lambda k: k == b)) / F.size(kept))
    return F.when(F.size(kept) > 0, -total(F.transform(shares, lambda p: p * F.log2(p))) / F.log2(F.lit(bins)))


def entropy(a: Column) -> Column:
    """Shannon entropy of values taken as shares of their sum."""
    x = F.transform(a, lambda v: v + 1e-12)
    return -total(F.transform(x, lambda v: (v / total(x)) * F.log2(v / total(x) + 1e-12)))


def resampled(a: Column, n: int) -> Column:
    """n values at equal steps from the first to the last, linear in between (n above 1)."""

    def at(k):
        x = k * (F.size(a) - 1) / F.lit(n - 1)
        low = F.least(F.floor(x), F.size(a) - 2).cast("int")
        return F.get(a, low) + (F.get(a, low + 1) - F.get(a, low)) * (x - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; 0 where one of them is constant."""
    x, y = F.transform(a, lambda v: v - mean(a)), F.transform(b, lambda v: v - mean(b))
    return F.coalesce(F.try_divide(total(F.zip_with(x, y, lambda p, q: p * q)), F.sqrt(total(F.transform(x, lambda p: p * p)) * total(F.transform(y, lambda p: p * p)))), F.lit(0.0))
