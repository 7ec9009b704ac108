"""Analytics over job events: ``job_events(job_id, stage, event, ts, retry, error)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.operators.ordered import halving_average


def job_counters(events: DataFrame) -> DataFrame:
    """Jobs processed, completed, failed and still active."""
    state = events.groupBy("job_id").agg(
        F.count_if(F.col("event") == "completed").alias("completed"),
        F.count_if(F.col("event") == "failed").alias("failed"),
    )
    done, bad = F.col("completed") > 0, (F.col("completed") == 0) & (F.col("failed") > 0)
    return state.agg(
        F.count(F.lit(1)).alias("submitted"),
        F.count_if(done | bad).alias("processed"),
        F.count_if(done).alias("completed"),
        F.count_if(bad).alias("failed"),
        F.count_if(~done & ~bad).alias("active"),
    )


def average_durations(durations: DataFrame, keys: list[str], ts: str, value: str, tie: str, chunk: str = "hour") -> DataFrame:
    """Halving average per key and over everything (key columns null)."""
    per_key = halving_average(durations, keys, ts, value, tie, chunk)
    # everything together is one series: its chunks are minutes, so that no task has a busy hour of all keys
    total = halving_average(durations.withColumn("__all", F.lit(1)), ["__all"], ts, value, tie, "minute").drop("__all")
    for k in keys:
        total = total.withColumn(k, F.lit(None).cast(durations.schema[k].dataType))
    return per_key.unionByName(total)


def retry_report(events: DataFrame, max_retries: int = 2) -> DataFrame:
    """Attempts, last stage and final state per job; more than ``max_retries`` retries is a failure."""
    return events.groupBy("job_id").agg(
        F.max("retry").alias("retries"),
        F.max_by("stage", F.struct("ts", "stage")).alias("last_stage"),
        F.max_by("error", F.struct("ts", "error")).alias("last_error"),
        F.max(F.col("event") == "completed").alias("__done"),
    ).withColumn(
        "state",
        F.when(F.col("__done"), "COMPLETED").when(F.col("retries") > max_retries, "FAILED").otherwise("ACTIVE"),
    ).drop("__done")


def newest_completed(jobs: DataFrame, keep: int = 50, ts: str = "completed_at", tie: str = "job_id") -> DataFrame:
    return jobs.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(keep)
