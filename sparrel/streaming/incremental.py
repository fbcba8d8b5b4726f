"""Metrics over a stream of scored rows: the batch definitions of rows, accuracy and error directions, kept up to date.  Beyond what a batch run needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(stream: DataFrame, time: str, by: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and accuracy of each window and group; rows later than the watermark allows are left out, as the engine defines."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), F.col(by))
    return grouped.agg(F.count("*").alias("rows"), F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"))


def error_directions(stream: DataFrame, time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Wrong rows of each window by truth and prediction."""
    wrong = stream.where("label <> prediction").withWatermark(time, late)
    return wrong.groupBy(F.window(time, window).alias("window"), "label", "prediction").agg(F.count("*").alias("errors"))
