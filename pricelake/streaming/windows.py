"""Live log counts, late-data split, seen-URL suppression, blocked sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.functions import urls
from pricelake.operators.serp import breaker_event


def split_late(rows: DataFrame, max_age_hours: int = 168, ts: str = "ts", arrived: str = "ingest_ts") -> tuple[DataFrame, DataFrame]:
    """(kept, refused): a row is refused when it is older than the limit on arrival.

    Stateless, so it works the same in batch and stream; the watermark of later operators is a
    separate matter (it is relative to the newest event, this rule to the arrival time).
    """
    late = F.coalesce(F.col(ts) < F.col(arrived) - F.expr(f"INTERVAL {int(max_age_hours)} HOURS"), F.lit(True))
    return rows.filter(~late), rows.filter(late)


def live_counts(
    logs: DataFrame, range_seconds: int, step_seconds: int | None = None, by: list[str] | None = None,
    delay: str = "10 minutes", ts: str = "ts",
) -> DataFrame:
    """Windowed counts over a stream, final once the watermark has passed the window."""
    step = step_seconds or range_seconds
    frame = F.window(F.col(ts), f"{range_seconds} seconds", f"{step} seconds")
    return (
        logs.withWatermark(ts, delay)
        .groupBy(frame, *[F.col(c) for c in (by or [])])
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(by or []), "n")
    )


def live_distinct(logs: DataFrame, label: str, range_seconds: int, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Approximate distinct labels per window; the state is one sketch per window."""
    return (
        logs.withWatermark(ts, delay)
        .groupBy(F.window(F.col(ts), f"{range_seconds} seconds"))
        .agg(F.approx_count_distinct(label).alias("n"))
        .select(F.col("window.start").alias("window_start"), "n")
    )


def suppress_seen(rows: DataFrame, url: str = "url", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Drop URLs seen before, by normalized form, within the watermark delay."""
    return (
        rows.withColumn("norm_url", urls.normalize(F.col(url)))
        .withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark(["norm_url"])
    )


def blocked_sessions(fetch_log: DataFrame, gap: str = "30 minutes", delay: str = "30 minutes", min_chars: int = 0) -> DataFrame:
    """Runs of blocked fetches per engine, closed by a pause of ``gap``."""
    return (
        fetch_log.withColumn("event", breaker_event(min_chars))
        .filter(F.col("event") == "open")
        .withWatermark("ts", delay)
        .groupBy("engine", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("fetches"))
        .select(
            "engine", F.col("session_window.start").alias("blocked_from"),
            F.col("session_window.end").alias("blocked_until"), "fetches",
        )
    )
