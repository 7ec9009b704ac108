"""Parquet tables by location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, location: str, spread: bool = False) -> DataFrame:
    """Table at ``location``. Times without a zone are read as UTC instants, so that filters on them
    still reach the scan.

    ``spread`` is for work that costs much CPU per row: a table of few large row groups is split over
    all cores first. A table that already has a partition per core is read as it is.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    df = spark.read.parquet(location)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
