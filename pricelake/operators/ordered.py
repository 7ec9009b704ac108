"""Exact per-key order operators that never put one key into one task.

A key may hold a third of all rows, so each key is cut into time chunks; windows run inside a chunk
and one small row per chunk carries the state across chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.session import cut_lineage, small_side

_CHUNK = "__chunk"


def _chunked(df: DataFrame, ts: str, chunk: str) -> DataFrame:
    return df.withColumn(_CHUNK, F.date_trunc(chunk, F.col(ts)))


def with_previous(
    df: DataFrame, keys: list[str], ts: str, value: Column, name: str, tie: str | None = None, chunk: str = "hour"
) -> DataFrame:
    """Add ``name`` = ``value`` of the previous row of the key in (ts, tie) order.

    ``value`` must be a struct so that "no previous row" and "previous value is null" differ.
    """
    order = [ts] + ([tie] if tie else [])
    rows = _chunked(df, ts, chunk).withColumn("__v", value)
    last = rows.groupBy(*keys, _CHUNK).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    carried = last.select(
        *keys, _CHUNK, F.lag("__last").over(Window.partitionBy(*keys).orderBy(_CHUNK)).alias("__carry")
    )
    inside = F.lag("__v").over(Window.partitionBy(*keys, _CHUNK).orderBy(*order))
    return (
        rows.withColumn("__in", inside)
        .join(carried, [*keys, _CHUNK], "left")
        .withColumn(name, F.coalesce("__in", "__carry"))
        .drop(_CHUNK, "__v", "__in", "__carry")
    )


def with_last_mark(
    df: DataFrame, keys: list[str], ts: str, mark: Column, name: str, tie: str | None = None, chunk: str = "hour"
) -> DataFrame:
    """Forward fill: add ``name`` = latest non-null ``mark`` at or before each row of the key."""
    order = [ts] + ([tie] if tie else [])
    rows = _chunked(df, ts, chunk).withColumn("__m", mark)
    marked = F.when(F.col("__m").isNotNull(), F.struct(*order))
    last = rows.groupBy(*keys, _CHUNK).agg(F.max_by("__m", marked).alias("__last"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, _CHUNK, F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    inside = F.last("__m", ignorenulls=True).over(
        Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("__in", inside)
        .join(carried, [*keys, _CHUNK], "left")
        .withColumn(name, F.coalesce("__in", "__carry"))
        .drop(_CHUNK, "__m", "__in", "__carry")
    )


def running_total(
    df: DataFrame, keys: list[str], ts: str, value: Column, name: str, tie: str | None = None, chunk: str = "hour"
) -> DataFrame:
    """Running sum per key, chunk by chunk."""
    order = [ts] + ([tie] if tie else [])
    rows = _chunked(df, ts, chunk).withColumn("__v", value)
    sums = rows.groupBy(*keys, _CHUNK).agg(F.sum("__v").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, _CHUNK, F.sum("__sum").over(before).alias("__carry"))
    inside = F.sum("__v").over(
        Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("__in", inside)
        .join(carried, [*keys, _CHUNK], "left")
        .withColumn(name, F.col("__in") + F.coalesce("__carry", F.lit(0)))
        .drop(_CHUNK, "__v", "__in", "__carry")
    )


def halving_average(df: DataFrame, keys: list[str], ts: str, value: str, tie: str, chunk: str = "hour") -> DataFrame:
    """``avg = (avg + x) / 2`` in completion order, starting at 0, as a closed form.

    A chunk of n rows maps avg to avg / 2**n + s; chunk results combine the same way, so a key is
    reduced by many tasks and joined from one row per chunk.
    """
    rows = _chunked(df, ts, chunk)
    back = Window.partitionBy(*keys, _CHUNK).orderBy(F.col(ts).desc(), F.col(tie).desc())
    parts = (
        rows.withColumn("__back", F.row_number().over(back))
        .groupBy(*keys, _CHUNK)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.sum(F.col(value) * F.pow(F.lit(2.0), -F.col("__back"))).alias("__s"),
        )
    )
    later = Window.partitionBy(*keys).orderBy(F.col(_CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    shifted = parts.withColumn("__after", F.coalesce(F.sum("__n").over(later), F.lit(0)))
    return shifted.groupBy(*keys).agg(
        F.sum(F.col("__s") * F.pow(F.lit(2.0), -F.col("__after"))).alias("average"),
        F.sum("__n").alias("n"),
    )


def placed(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Unique number per row that rises with ``order`` within each key, with gaps: a range shuffle and no join.

    Numbers follow partitions, so write the result down before reading it more than once.
    """
    return df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(name, F.monotonically_increasing_id())


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """1-based rank per key over any number of rows.

    A range shuffle on (keys, order) also splits a large key; the checkpoint pins partition borders,
    and one row per (key, partition) carries the offset.
    """
    pinned = cut_lineage(placed(df, keys, order, "__id")).withColumn("__part", F.shiftright("__id", 33))
    sizes = pinned.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:  # one row per partition
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # counted before it is broadcast: rows are keys plus partitions
    offsets = small_side(sizes.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    return (
        pinned.join(offsets, [*keys, "__part"])
        .withColumn(name, F.col("__off") + F.col("__id") - F.col("__first") + 1)
        .drop("__id", "__part", "__first", "__off")
    )
