"""The file-drop form of the pipeline: predictions that arrive as files, cells rebuilt as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.keys import parse_key
from gridloom.sources.tables import PREDICTIONS


def prediction_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    df = spark.readStream.schema(PREDICTIONS).option("header", True).option("maxFilesPerTrigger", per_trigger).csv(path)
    return df.withColumn("key", parse_key(F.col("filename"))).where("key IS NOT NULL")


def cell_confidence(stream: DataFrame) -> DataFrame:
    """Running count and mean confidence of each cell's characters."""
    return stream.groupBy(F.col("key.r").alias("r"), F.col("key.c").alias("c")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


def append_cells(stream: DataFrame, path: str, checkpoint: str):
    """Write each batch's parsed rows once: the batch id names its folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
