"""Operations on sets of columns: selecting, cleaning, encoding, correlations, folds."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.evaluate import summed_before

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric(df: DataFrame) -> DataFrame:
    """The numeric columns alone."""
    return df.select(*(c for c, kind in df.dtypes if kind.split("(")[0] in NUMBERS))


def varying(df: DataFrame, least: float = 1e-6) -> DataFrame:
    """Numeric columns whose sample deviation is above ``least``; all are measured in one pass."""
    spread = df.agg(*(F.stddev_samp(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if spread[c] is not None and spread[c] > least))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without these columns, whether or not it has them."""
    return df.drop(*names)


def finite(df: DataFrame, names: list[str]) -> DataFrame:
    """Null, NaN and infinities become 0."""
    clean = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    return df.withColumns({n: clean(F.col(n)) for n in names})


def one_hot(df: DataFrame, name: str, prefix: str, values: list | None = None) -> DataFrame:
    """df with a 0/1 column for each value of a column but the first in order, in place of it. Columns are a schema, so the
    values have to be few: they are read from the data if none are given."""
    if values is None:
        values = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).collect()]
    return df.select(*(c for c in df.columns if c != name), *(F.coalesce((F.col(name) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values[1:]))


def array_members(name: str, prefix: str, n: int) -> dict[str, Column]:
    return {f"{prefix}_{i + 1}": F.get(F.col(name), F.lit(i)) for i in range(n)}


def promoted(df: DataFrame, group: list[str], number: Column, score: str) -> DataFrame:
    """df with label: NUMBER, with score 1, for all rows of a group in which any row is a number, else OTHER."""
    found = F.bool_or(number).over(Window.partitionBy(*group))
    return df.withColumn("__any", found).withColumn("label", F.when(F.col("__any"), "NUMBER").otherwise("OTHER")).withColumn(score, F.when(F.col("__any"), 1.0).otherwise(F.col(score))).drop("__any")


def ranked(df: DataFrame, name: str) -> DataFrame:
    """df with the column's values replaced by their ranks from 1; equal values share their mean rank."""
    counts = df.groupBy(name).agg(F.count("*").alias("n"))
    places = summed_before(counts, name, ["n"]).select(F.col(name).alias("__v"), (F.col("__n") + (F.col("n") + 1) / 2).alias("__rank"))
    return df.join(places, F.col(name) == F.col("__v")).withColumn(name, F.col("__rank")).drop("__v", "__rank")


def correlations(df: DataFrame, names: list[str], ranks: bool = False) -> DataFrame:
    """(x, y, r) for each pair x < y of columns: Pearson, or Spearman as that of the ranks. One pass for all pairs."""
    df = df.select(*names)
    for n in names if ranks else ():
        df = ranked(df, n)
    pairs = [tuple(sorted(p)) for p in combinations(names, 2)]
    wide = df.agg(*(F.corr(x, y).alias(f"{i}") for i, (x, y) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{i}").alias("r")) for i, (x, y) in enumerate(pairs)))
    return wide.select(F.inline(rows))


def folds(df: DataFrame, label: str, order: list[str], n: int) -> DataFrame:
    """df with fold 0 to n - 1, each label dealt round the folds in order."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order)) - 1
    return df.withColumn("fold", (place % n).cast("long"))


def shuffle_key(names: list[str], factors: list[int], seed: int, modulus: int) -> Column:
    """A key that scatters rows, the same for the same seed; order by it to shuffle."""
    return sum((F.col(c) * f for c, f in zip(names, factors)), F.lit(seed)) % modulus
