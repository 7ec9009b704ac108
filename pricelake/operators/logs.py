"""Log analytics over lines and over parsed requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.functions import rules

_CRI = r"(?s)^(\S+) (stdout|stderr) (\S+) (.*)$"
_NAME = r"([^/_]+)_([^/_]+)_([^/]+)-[0-9a-f]{64}\.log$"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Container lines (path, raw) to (ts, stream, flags, line, job, filename, namespace, container)."""
    part = lambda i: F.regexp_extract("raw", _CRI, i)
    framed = F.col("raw").rlike(_CRI)
    return lines.select(
        F.when(framed, F.try_to_timestamp(part(1))).alias("ts"),
        F.when(framed, part(2)).alias("stream"),
        F.when(framed, part(3)).alias("flags"),
        F.when(framed, part(4)).otherwise(F.col("raw")).alias("line"),
        job_of(F.col("path")).alias("job"),
        F.col("path").alias("filename"),
        F.regexp_extract("path", r"/[^/_]+_([^/_]+)_[^/]*$", 1).alias("namespace"),
        F.regexp_extract("path", r"/[^/_]+_[^/_]+_(.+?)(?:-[0-9a-f]{64})?\.log$", 1).alias("container"),
    )


# client, user, time, request, status and size of an access line
_ACCESS = r'^(\S+) \S+ \S+ \[([^\]]*)\] "([A-Z]+) ([^\s"?]*)(?:\?[^\s"]*)?(?: [^"]*)?" (\d{3}) (\d+|-)'


def access_fields(logs: DataFrame, line: str = "line") -> DataFrame:
    """Add client, method, path (without its query), status and size read from access lines; null for other lines."""
    part = lambda i: F.when(F.col(line).rlike(_ACCESS), F.regexp_extract(line, _ACCESS, i))
    return logs.select(
        "*", part(1).alias("client"), part(3).alias("method"), part(4).alias("path"), part(5).cast("int").alias("status"),
        part(6).try_cast("bigint").alias("size"),
    )


def job_of(path: Column) -> Column:
    """Route of a log file; the first matching route names the job."""
    chain = None
    for job, pattern in rules.LOG_ROUTES:
        hit = path.rlike("^(?:file:(?://)?)?" + pattern + "$")
        chain = F.when(hit, job) if chain is None else chain.when(hit, job)
    return chain


def tag_drops(logs: DataFrame) -> DataFrame:
    """Reason a line is refused, or null. The first rule that matches counts."""
    tests = [
        F.when((F.col("job") == job) & F.col("line").rlike(pattern), reason)
        for job, pattern, reason in rules.LOG_DROP_RULES
    ]
    return logs.withColumn("drop_reason", F.coalesce(*tests))


def kept_lines(logs: DataFrame) -> DataFrame:
    return tag_drops(logs).filter(F.col("drop_reason").isNull()).drop("drop_reason")


def drop_counts(logs: DataFrame) -> DataFrame:
    return (
        tag_drops(logs)
        .filter(F.col("drop_reason").isNotNull())
        .groupBy("drop_reason")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def matching(logs: DataFrame, contains: list[str] | None = None, pattern: str | None = None, line: str = "line") -> DataFrame:
    """Line filter: any of the substrings, and the pattern."""
    out = logs
    if contains:
        test = F.lit(False)
        for text in contains:
            test = test | F.col(line).contains(text)
        out = out.filter(test)
    return out.filter(F.col(line).rlike(pattern)) if pattern else out


def count_over_time(
    logs: DataFrame, range_seconds: int, step_seconds: int | None = None, by: list[str] | None = None, ts: str = "ts"
) -> DataFrame:
    """Rows per window (start included, end excluded) and label set.

    A sliding window is summed from step-sized counts: every row is counted once before the shuffle
    instead of being copied into each window it belongs to.
    """
    by, step = by or [], step_seconds or range_seconds
    if range_seconds % step:
        raise ValueError("range must be a multiple of step")
    bucket = F.floor(F.unix_micros(F.col(ts)) / (step * 1000000)) * step
    counts = logs.groupBy(bucket.alias("__b"), *by).agg(F.count(F.lit(1)).alias("n"))
    if step != range_seconds:
        counts = (
            counts.withColumn("__b", F.explode(F.sequence(F.col("__b") - (range_seconds - step), F.col("__b"), F.lit(step).cast("bigint"))))
            .groupBy("__b", *by)
            .agg(F.sum("n").alias("n"))
        )
    return counts.select(
        F.timestamp_seconds("__b").alias("window_start"),
        F.timestamp_seconds(F.col("__b") + range_seconds).alias("window_end"),
        *by,
        "n",
    )


def rate(counts: DataFrame, range_seconds: int) -> DataFrame:
    return counts.withColumn("per_second", F.col("n") / float(range_seconds))


def noisiest(logs: DataFrame, label: str, range_seconds: int, ts: str = "ts") -> DataFrame:
    """Counts per window and source, loudest first."""
    return count_over_time(logs, range_seconds, by=[label], ts=ts).orderBy("window_start", F.col("n").desc(), label)


def distinct_over_time(logs: DataFrame, label: str, range_seconds: int, ts: str = "ts", approximate: bool = False) -> DataFrame:
    start = F.floor(F.unix_micros(F.col(ts)) / (range_seconds * 1000000)) * range_seconds
    count = F.approx_count_distinct(label) if approximate else F.count_distinct(label)
    return logs.groupBy(F.timestamp_seconds(start).alias("window_start")).agg(count.alias("n"))


def status_classes(logs: DataFrame, status: str, range_seconds: int, ts: str = "ts") -> DataFrame:
    """Requests per second of the 2xx, 4xx and 5xx classes per window, in one aggregation."""
    start = F.floor(F.unix_micros(F.col(ts)) / (range_seconds * 1000000)) * range_seconds
    kind = F.floor(F.col(status) / 100)
    return logs.groupBy(F.timestamp_seconds(start).alias("window_start")).agg(
        *[(F.count_if(kind == c) / float(range_seconds)).alias(f"rate_{c}xx") for c in (2, 4, 5)]
    )


def top_labels(logs: DataFrame, label: str, k: int = 10) -> DataFrame:
    return logs.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(k)


def top_labels_per_window(logs: DataFrame, label: str, range_seconds: int, k: int = 10, ts: str = "ts") -> DataFrame:
    counts = count_over_time(logs, range_seconds, by=[label], ts=ts)
    order = Window.partitionBy("window_start").orderBy(F.col("n").desc(), label)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recent_lines(logs: DataFrame, n: int = 100, ts: str = "ts", tie: str = "line") -> DataFrame:
    return logs.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def heat_map(logs: DataFrame, start: datetime, end: datetime, bucket_seconds: int = 300, ts: str = "ts") -> DataFrame:
    """Volume per bucket over a range; empty buckets count 0."""
    spark = logs.sparkSession
    grid = spark.range(int(start.timestamp()), int(end.timestamp()), bucket_seconds).select(
        F.timestamp_seconds("id").alias("bucket")
    )
    at = F.timestamp_seconds(F.floor(F.unix_micros(F.col(ts)) / (bucket_seconds * 1000000)) * bucket_seconds)
    inside = logs.filter((F.col(ts) >= F.timestamp_seconds(F.lit(int(start.timestamp())))) & (F.col(ts) < F.timestamp_seconds(F.lit(int(end.timestamp())))))
    counts = inside.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def threshold_colour(value: Column, low: float, high: float) -> Column:
    return F.when(value >= high, "red").when(value >= low, "yellow").otherwise("green")


def lookback(rows: DataFrame, as_of: datetime, days: int, max_range_days: int | None = None, ts: str = "ts") -> DataFrame:
    """Rows a query may still see; a range beyond the allowed one is refused."""
    if max_range_days is not None and days > max_range_days:
        raise ValueError(f"range of {days} days is longer than {max_range_days}")
    return rows.filter((F.col(ts) > F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(ts) <= F.lit(as_of)))
