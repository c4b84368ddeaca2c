"""Writers: CSV, routed and partitioned tables, JSON reports, PNG files."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.raster import write_png


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_routed(df: DataFrame, path: str, route: str) -> None:
    """One folder for each value of ``route``."""
    df.write.partitionBy(route).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object for each row."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def png_bytes(df: DataFrame, h: int, w: int, px: str = "px", name: str = "png") -> DataFrame:
    """df with each raster (0..255) encoded as a PNG file's bytes."""
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: write_png(np.asarray(a).reshape(h, w)))

    return df.withColumn(name, run(F.col(px)))


def write_pngs(df: DataFrame, folder: str, h: int, w: int, px: str = "px", key: str = "filename") -> None:
    """A PNG file for each row, named by its key, in a folder that all executors share. A task that is run again writes the
    same files; a file is there whole or not at all."""

    def run(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = f"{folder}/.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(write_png(np.asarray(r[px]).reshape(h, w)))
            os.replace(part, f"{folder}/{os.path.basename(r[key])}")

    df.select(key, px).foreachPartition(run)


def write_coordinates(df: DataFrame, path: str) -> None:
    """row, col, x1, y1, x2, y2 of cells with corners top_left and bottom_right (structs of x, y)."""
    corner = lambda c, n: [F.col(f"{c}.x").alias(f"x{n}"), F.col(f"{c}.y").alias(f"y{n}")]
    write_csv(df.select("row", "col", *corner("top_left", 1), *corner("bottom_right", 2)), path)


def write_pivoted(df: DataFrame, path: str, row: str, column: str, value: str) -> None:
    """A table of row x column with the row's label first."""
    wide = df.groupBy(F.col(row).alias("row_label")).pivot(column).agg(F.first(value))
    write_csv(wide.orderBy("row_label"), path)


def append_csv(df: DataFrame, path: str) -> None:
    """More rows to a folder of CSV files, each of which begins with the header."""
    write_csv(df, path, "append")


def rewrite(spark, path: str, change) -> None:
    """The CSV table at path, changed: written beside it, then put in its place, never over what is being read."""
    df = change(spark.read.option("header", True).csv(path))
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    beside, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    write_csv(df, beside)
    files = at(path).getFileSystem(hadoop)
    if not files.rename(at(path), at(old)) or not files.rename(at(beside), at(path)):
        raise OSError(f"can't put {beside} in the place of {path}")
    files.delete(at(old), True)


def write_text_report(df: DataFrame, path: str, pattern: str, columns: list[str]) -> None:
    """One line of text for each row, by a printf pattern."""
    df.select(F.format_string(pattern, *columns).alias("value")).coalesce(1).write.text(path)
