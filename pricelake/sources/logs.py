"""Container log lines as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log_lines(spark: SparkSession, location: str, streaming: bool = False) -> DataFrame:
    """(path, raw) rows from text files, batch or stream."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("text").load(location)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
