"""Readers of images, keyed CSV files, word lists and class lists, with explicit schemas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.keys import basename, cell_set, parse_key
from gridloom.operators.vision import resize_area, resize_cubic

PREDICTIONS = "filename string, predicted_class int, confidence double"
LABELS = "filename string, true_digit int"


def images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(filename, h, w, channels, data) of decoded images."""
    df = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", glob).load(path)
    return df.select(basename(F.col("image.origin")).alias("filename"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def sorted_images(spark: SparkSession, path: str, extensions: tuple = ("png", "jpg", "jpeg", "bmp")) -> DataFrame:
    """images of several kinds, in the order of their names."""
    return images(spark, path, "*.{" + ",".join(extensions) + "}").orderBy("filename")


def pixels(spark: SparkSession, path: str, size: tuple | None = None, glob: str = "*.png", unit: bool = True) -> DataFrame:
    """(filename, h, w, px): grey rasters, row by row, in 0..1 (or 0..255), resized to ``size`` (h, w) on the way if given.

    One channel is taken as it is; of three or four (the fourth says how opaque a pixel is, and is left out) the usual
    weights of blue, green and red make the grey."""

    @F.pandas_udf("struct<h:int,w:int,px:array<double>>")
    def read(h: pd.Series, w: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, raw in zip(h, w, channels, data):
            grey = np.frombuffer(raw, np.uint8).reshape(a, b, c).astype(float)
            grey = grey[:, :, 0] if c == 1 else np.rint(grey[:, :, :3] @ np.array([0.114, 0.587, 0.299]))
            if size and (a, b) != size:
                grey = np.clip((resize_area if size[0] <= a and size[1] <= b else resize_cubic)(grey, *size), 0, 255)
            rows.append((*grey.shape, (grey / 255 if unit else grey).ravel().tolist()))
        return pd.DataFrame(rows, columns=["h", "w", "px"])

    return images(spark, path, glob).select("filename", read("h", "w", "channels", "data").alias("r")).select("filename", "r.h", "r.w", "r.px")


def image_cells(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """The distinct (r, c) among the names of a folder's images."""
    return cell_set(image_keys(spark, path, glob).select("filename"))


def indexed_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A table whose first column holds the row labels: (row_label, columns)."""
    return spark.read.schema(f"row_label string, {columns}").option("header", True).csv(path)


def same_columns(a: DataFrame, b: DataFrame) -> dict:
    """The columns that only one of two tables has, in order, and whether all are the same."""
    only = lambda x, y: [c for c in x.columns if c not in y.columns]
    return {"same": a.columns == b.columns, "first": only(a, b), "second": only(b, a)}


def image_keys(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Keys of a folder's images; contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(basename(F.col("path")).alias("filename"))
    return df.withColumn("key", parse_key(F.col("filename")))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def checked_labels(spark: SparkSession, path: str, schema: str, column: str, domain: list) -> DataFrame:
    """Labels whose header must match and whose values must lie in the domain (strings in any case)."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    value = F.upper(F.trim(column)) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.withColumn(column, F.when(value.isin(domain), value).otherwise(F.raise_error(F.concat(F.lit("label out of domain: "), F.coalesce(value.cast("string"), F.lit("null"))))))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(token): the text before the first comma of each line that isn't blank; a byte order mark goes."""
    line = F.trim(F.regexp_replace("value", "^﻿", ""))
    return spark.read.text(path).select(F.trim(F.substring_index(line, ",", 1)).alias("token")).where("token <> ''")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of "key, value" lines."""
    parts = F.split("value", ", ", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def classes(spark: SparkSession, path: str) -> DataFrame:
    """(class, id) of a JSON list of names."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r'"([^"]*)"'), F.lit(1))).alias("id", "class"))
