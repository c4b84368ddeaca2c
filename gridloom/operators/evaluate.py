"""Predictions against labels: confusion, scores for each class, summaries, ROC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """(truth, predicted, n), a row for every pair of classes."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], [truth, predicted]).select(F.col(truth).cast("int"), F.col(predicted).cast("int"))
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return grid.join(counts, [truth, predicted], "left").fillna(0, ["n"])


def class_scores(matrix: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) from a confusion table; 0 / 0 is 0."""
    hit = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0))
    by_truth = matrix.groupBy(F.col(truth).alias("class")).agg(hit.alias("tp"), F.sum("n").alias("support"))
    by_predicted = matrix.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("said"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    both = by_truth.join(by_predicted, "class").withColumn("precision", ratio(F.col("tp"), F.col("said"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return both.select("class", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


#: Equal-width bins of the scores' range; sums run within a bin, and over the bins' totals.
BINS = 4096


def summed_before(each: DataFrame, score: str, columns: list, descending: bool = False) -> DataFrame:
    """each (a row for each distinct score), and as __<column> the column's sum over all rows that come before.

    No task holds all scores: rows are in order within their bin, and a table of no more than BINS totals is broadcast.
    A null score is the least, NaN the greatest."""
    x = F.col(score).cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    ends = each.agg(F.min(finite).alias("__lo"), F.max(finite).alias("__hi"))  # one row
    share = F.coalesce(F.try_divide(x - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    place = F.when(F.isnan(x), BINS - 1).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(BINS - 1.0), share * BINS)))).cast("int")
    placed = each.crossJoin(F.broadcast(ends)).withColumn("__bin", place)
    way = F.desc if descending else F.asc
    inner = Window.partitionBy("__bin").orderBy(way(score)).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(F.lit(0)).orderBy(way("__b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(F.col("__bin").alias("__b")).agg(*(F.sum(c).alias(c) for c in columns))
    totals = totals.select("__b", *(F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"__up_{c}") for c in columns))
    both = placed.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"__in_{c}") for c in columns)).join(F.broadcast(totals), F.col("__bin") == F.col("__b"))
    return both.select(*each.columns, *((F.col(f"__in_{c}") + F.col(f"__up_{c}")).alias(f"__{c}") for c in columns))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tp, fp) after each distinct score, from the highest down."""
    each = df.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    return summed_before(each, score, ["p", "q"], descending=True).select(score, (F.col("__p") + F.col("p")).alias("tp"), (F.col("__q") + F.col("q")).alias("fp"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties averaged. Counts are taken for each distinct score first."""
    each = df.groupBy(score).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    sums = summed_before(each, score, ["n"]).withColumn("rank", F.col("__n") + (F.col("n") + 1) / 2).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def averages(scores: DataFrame) -> DataFrame:
    """(average, precision, recall, f1) of class_scores: macro (each class counts alike) and weighted (by support)."""
    names = ("precision", "recall", "f1")
    macro = scores.agg(*(F.avg(n).alias(n) for n in names)).select(F.lit("macro").alias("average"), *names)
    weighted = scores.agg(*(F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names)).select(F.lit("weighted").alias("average"), *names)
    return macro.unionByName(weighted)
