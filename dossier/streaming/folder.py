"""Incremental folder scans as a stream: files are read once, when they are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.scoring import CONFIDENT, GUESS


def new_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of each new text file below a folder."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_new(stream: DataFrame, target: str, checkpoint: str):
    """Starts a query that appends what is new to a Parquet table and then ends."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_bands(scores: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Numbers of confident, guessed and unlikely files by window of the ``ts`` column, for batch and stream alike."""
    src = scores.withWatermark("ts", late) if scores.isStreaming else scores
    return src.groupBy(F.window("ts", width)).agg(
        F.count_if(F.col("score") >= CONFIDENT).alias("confident"), F.count_if((F.col("score") >= GUESS) & (F.col("score") < CONFIDENT)).alias("guess"), F.count_if(F.col("score") < GUESS).alias("none")
    )
