"""Continuous page upsert: versions are appended by Spark's file sink and reduced per URL when read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pricelake.operators.store import upsert_pages


def land_versions(stream: DataFrame, location: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every micro-batch of page versions; the sink's own log says which files count, so a repeated batch does no harm."""
    writer = stream.writeStream.format("parquet").option("path", location).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current(base: DataFrame, location: str, fetched_at: str = "fetched_at") -> DataFrame:
    """Pages as of the last landed batch: ``base`` (maybe empty) with the newest landed version of each URL."""
    return upsert_pages(base, base.sparkSession.read.parquet(location), fetched_at)
