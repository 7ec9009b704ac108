"""Metric analytics over ``samples(ts, metric, labels MAP<STRING,STRING>, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.operators.ordered import running_total, with_last_mark, with_previous
from pricelake.session import cut_lineage


def match_labels(
    samples: DataFrame,
    metric: str | None = None,
    equal: dict[str, str] | None = None,
    unequal: dict[str, str] | None = None,
    pattern: dict[str, str] | None = None,
) -> DataFrame:
    """Series selection by metric name and labels; patterns are anchored, a missing label is empty."""
    label = lambda name: F.coalesce(F.try_element_at("labels", F.lit(name)), F.lit(""))
    out = samples.filter(F.col("metric") == metric) if metric else samples
    for name, value in (equal or {}).items():
        out = out.filter(label(name) == value)
    for name, value in (unequal or {}).items():
        out = out.filter(label(name) != value)
    for name, value in (pattern or {}).items():
        out = out.filter(label(name).rlike(f"^(?:{value})$"))
    return out


def label_columns(samples: DataFrame, names: list[str]) -> DataFrame:
    """Labels as columns, which are the series key of the operators below."""
    return samples.select("ts", "metric", "value", *[F.try_element_at("labels", F.lit(n)).alias(n) for n in names])


def counter_deltas(samples: DataFrame, series: list[str], tie: str | None = None, chunk: str = "hour") -> DataFrame:
    """Growth since the previous sample of the series; after a reset the new value is the growth.

    The first sample of a series grows by nothing.
    """
    rows = with_previous(samples, series, "ts", F.struct("ts", "value"), "prev", tie, chunk)
    delta = F.when(F.col("value") >= F.col("prev.value"), F.col("value") - F.col("prev.value")).otherwise(F.col("value"))
    return rows.withColumn("delta", F.when(F.col("prev").isNull(), 0.0).otherwise(delta))


def increase(samples: DataFrame, series: list[str], range_seconds: int, tie: str | None = None, chunk: str = "hour") -> DataFrame:
    """Counter growth and per-second rate per series and window."""
    start = F.floor(F.unix_micros("ts") / (range_seconds * 1000000)) * range_seconds
    return (
        counter_deltas(samples, series, tie, chunk)
        .groupBy(*series, F.timestamp_seconds(start).alias("window_start"))
        .agg(F.sum("delta").alias("increase"))
        .withColumn("rate", F.col("increase") / float(range_seconds))
    )


def instant_rate(samples: DataFrame, series: list[str], range_seconds: int, tie: str | None = None, chunk: str = "hour") -> DataFrame:
    """Slope between the last two samples of each series inside each window."""
    start = F.timestamp_seconds(F.floor(F.unix_micros("ts") / (range_seconds * 1000000)) * range_seconds)
    rows = counter_deltas(samples, series, tie, chunk).withColumn("window_start", start)
    seconds = (F.unix_micros("ts") - F.unix_micros("prev.ts")) / 1000000.0
    slope = F.when((F.col("prev.ts") >= F.col("window_start")) & (seconds > 0), F.col("delta") / seconds)
    order = F.struct("ts", *([tie] if tie else []))
    return (
        rows.withColumn("slope", slope)
        .groupBy(*series, "window_start")
        .agg(F.max_by("slope", order).alias("irate"))
        .filter(F.col("irate").isNotNull())
    )


def latest(samples: DataFrame, series: list[str], as_of: Column | None = None, tie: str | None = None) -> DataFrame:
    """Latest sample per series; combines before the shuffle."""
    rows = samples.filter(F.col("ts") <= as_of) if as_of is not None else samples
    order = F.struct("ts", *([tie] if tie else []))
    return rows.groupBy(*series).agg(F.max_by("value", order).alias("value"), F.max("ts").alias("ts"))


def instant_by(samples: DataFrame, series: list[str], by: list[str], as_of: Column | None = None, tie: str | None = None) -> DataFrame:
    return latest(samples, series, as_of, tie).groupBy(*by).agg(
        F.sum("value").alias("sum_value"), F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("series")
    )


def side_by_side(samples: DataFrame, on: list[str], metrics: list[str], as_of: Column | None = None, tie: str | None = None) -> DataFrame:
    """Latest values of several metrics as columns of one row per label set, in one shuffle."""
    rows = samples.filter(F.col("metric").isin(metrics))
    if as_of is not None:
        rows = rows.filter(F.col("ts") <= as_of)
    order = F.struct("ts", *([tie] if tie else []))
    return rows.groupBy(*on).agg(
        *[F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, order)).alias(m) for m in metrics]
    )


def used_percent(total: Column, available: Column) -> Column:
    return F.when(total != 0, (total - available) / total * 100.0)


def top_series(rates: DataFrame, value: str, by: list[str], k: int = 10, rename: dict[str, str] | None = None) -> DataFrame:
    top = (
        rates.groupBy(*by)
        .agg(F.round(F.sum(value), 6).alias(value))
        .orderBy(F.col(value).desc(), *by)
        .limit(k)
    )
    return top.withColumnsRenamed(rename) if rename else top


# -- relabelling -----------------------------------------------------------------------------
def _joined(source: list[str]) -> Column:
    return F.concat_ws(";", *[F.coalesce(F.try_element_at("labels", F.lit(s)), F.lit("")) for s in source])


def relabel_keep(rows: DataFrame, source: list[str], pattern: str) -> DataFrame:
    """Keep targets whose joined source labels match the whole pattern."""
    return rows.filter(_joined(source).rlike(f"^(?:{pattern})$"))


def relabel_replace(rows: DataFrame, source: list[str], target: str, pattern: str = "(.*)", replacement: str = "$1") -> DataFrame:
    """Set a label from capture groups; rows that do not match keep their labels."""
    joined, whole = _joined(source), f"^(?:{pattern})$"
    value = F.regexp_replace(joined, whole, replacement)
    others = F.map_filter("labels", lambda k, v: k != target)
    return rows.withColumn(
        "labels",
        F.when(joined.rlike(whole), F.map_concat(others, F.create_map(F.lit(target), value))).otherwise(F.col("labels")),
    )


# -- alerts ----------------------------------------------------------------------------------
# ---- fixed values: alert rules (name, hold seconds, severity) ------------------------------
ALERT_RULES = [
    ("HighMemoryUsage", 300, "warning"),
    ("PodRestartingFrequently", 120, "warning"),
    ("ApplicationDown", 60, "critical"),
    ("HighErrorRate", 120, "warning"),
]
# ---- fixed values: alert thresholds --------------------------------------------------------
MEMORY_LIMIT, RESTART_RATE_LIMIT, ERROR_RATE_LIMIT = 0.85, 0.5, 0.1


def evaluation_points(
    samples: DataFrame, series: list[str], step_seconds: int = 30, tie: str | None = None, lookback_seconds: int = 0
) -> DataFrame:
    """Latest value of each series in each evaluation step.

    A step without a sample sees the last one, as long as that is at most ``lookback_seconds`` old; without lookback it
    has no row. The grid ends at the step of the newest sample of all.
    """
    if lookback_seconds:
        seen = evaluation_stretches(samples, series, step_seconds, lookback_seconds, tie)
        each = F.explode_outer(F.sequence("first", "last", F.lit(step_seconds).cast("bigint")))
        return seen.select(*series, each.alias("__at"), "value").select(*series, F.timestamp_seconds("__at").alias("eval_ts"), "value")
    return _step_values(samples, series, step_seconds, tie).select(*series, F.timestamp_seconds("__at").alias("eval_ts"), "value")


def _step_values(samples: DataFrame, series: list[str], step_seconds: int, tie: str | None) -> DataFrame:
    at = (F.floor(F.unix_micros("ts") / (step_seconds * 1000000)) + 1) * step_seconds
    order = F.struct("ts", *([tie] if tie else []))
    return samples.groupBy(*series, at.alias("__at")).agg(F.max_by("value", order).alias("value"), F.max("ts").alias("__seen"))


def evaluation_stretches(
    samples: DataFrame, series: list[str], step_seconds: int, lookback_seconds: int, tie: str | None = None
) -> DataFrame:
    """``evaluation_points`` with lookback, one row for all consecutive steps that see one sample: (series, first, last, value),
    times in seconds, both included. Samples without a time have a row without times."""
    points = cut_lineage(_step_values(samples, series, step_seconds, tie).withColumn("__ts", F.timestamp_seconds("__at")))
    end = points.agg(F.max("__at")).first()[0]
    last_seen = F.floor((F.unix_micros("__seen") / 1000000 + lookback_seconds) / step_seconds) * step_seconds
    until = lambda most: F.greatest(F.col("__at"), F.least(most, last_seen))
    row = F.struct("value", "__seen", "__at")
    linked = with_previous(points.filter("__at IS NOT NULL"), series, "__ts", row, "__prev").filter("__prev IS NOT NULL").select(
        *series, F.col("__at").alias("__here"), "__prev.*"
    )
    inner = linked.select(*series, F.col("__at").alias("first"), until(F.col("__here") - step_seconds).alias("last"), "value")
    tails = points.groupBy(*series).agg(F.max_by(row, "__at").alias("__l")).filter("__l IS NOT NULL").select(*series, "__l.*")
    ends = tails.select(*series, F.col("__at").alias("first"), until(F.lit(end)).alias("last"), "value")
    undated = points.filter("__at IS NULL").select(*series, F.col("__at").alias("first"), F.col("__at").alias("last"), "value")
    return inner.unionByName(ends).unionByName(undated)


def sliding_rates(steps: DataFrame, keys: list[str], range_seconds: int, step_seconds: int) -> DataFrame:
    """Rate over the range before each evaluation (keys, eval_ts, value) from increases per step (keys, at, d)."""
    each = F.explode(F.sequence("first", "last", F.lit(step_seconds).cast("bigint")))
    rates = rate_stretches(steps, keys, range_seconds, step_seconds).select(*keys, each.alias("e"), "value")
    return rates.select(*keys, F.timestamp_seconds("e").alias("eval_ts"), "value")


def rate_stretches(steps: DataFrame, keys: list[str], range_seconds: int, step_seconds: int) -> DataFrame:
    """``sliding_rates``, one row for all consecutive evaluations with one rate: (keys, first, last, value), times in seconds.

    A step enters the running total at its time and leaves it when the range has passed, two rows each; the total holds
    from one change to the next. Evaluations without a step in their range have no row.
    """
    change = lambda at, d, n: F.struct(at.alias("at"), d.alias("d"), F.lit(n).alias("n"))
    span = range_seconds // step_seconds * step_seconds
    enters, leaves = change(F.col("at"), F.col("d"), 1), change(F.col("at") + span, -F.col("d"), -1)
    changes = steps.select(*keys, F.explode(F.array(enters, leaves)).alias("c")).select(*keys, "c.*")
    changes = changes.groupBy(*keys, "at").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    rows = cut_lineage(changes.withColumn("__ts", F.timestamp_seconds("at")))
    rows = running_total(rows, keys, "__ts", F.col("d"), "total")
    rows = cut_lineage(running_total(rows, keys, "__ts", F.col("n"), "open"))
    held = with_previous(rows, keys, "__ts", F.struct("at", "total", "open"), "prev").filter("prev.open > 0")
    return held.select(
        *keys, F.col("prev.at").alias("first"), (F.col("at") - step_seconds).alias("last"), (F.col("prev.total") / float(range_seconds)).alias("value")
    )


def _side_by_side_stretches(stretches: DataFrame, keys: list[str], metrics: list[str], step_seconds: int) -> DataFrame:
    """Stretches (keys, metric, first, last, value) of two or more metrics as stretches in which all of them have a value, a column each.

    A metric changes where a stretch of it begins and behind its end; between two changes all stand still.
    """
    change = lambda at, on: F.struct(at.alias("at"), F.lit(on).alias("on"))
    changes = F.when(F.col("first").isNull(), F.array(change(F.col("first"), 1))).otherwise(
        F.array(change(F.col("first"), 1), change(F.col("last") + step_seconds, 0))
    )
    rows = stretches.select(*keys, "metric", "value", F.explode(changes).alias("c")).select(*keys, "metric", "value", "c.*")
    mark = lambda m: F.max(F.when(F.col("metric") == m, F.struct("on", F.when(F.col("on") == 1, F.col("value")).alias("value")))).alias(m)
    rows = cut_lineage(rows.groupBy(*keys, "at").agg(*[mark(m) for m in metrics]).withColumn("__ts", F.timestamp_seconds("at")))
    undated = rows.filter("at IS NULL").select(*keys, F.col("at").alias("first"), F.col("at").alias("last"), *metrics)
    rows = rows.filter("at IS NOT NULL")
    for m in metrics:
        rows = cut_lineage(with_last_mark(rows.withColumnRenamed(m, "__mark"), keys, "__ts", F.col("__mark"), m).drop("__mark"))
    held = with_previous(rows, keys, "__ts", F.struct("at", *metrics), "prev").filter("prev IS NOT NULL")
    held = held.select(*keys, F.col("prev.at").alias("first"), (F.col("at") - step_seconds).alias("last"), *[F.col("prev")[m].alias(m) for m in metrics])
    whole = held.unionByName(undated)
    for m in metrics:
        whole = whole.filter(F.col(m)["on"] == 1)
    return whole.select(*keys, "first", "last", *[F.col(m)["value"].alias(m) for m in metrics])


def alert_conditions(samples: DataFrame, step_seconds: int = 30, lookback_seconds: int = 300) -> DataFrame:
    """The four rules over ``samples`` as (alert, series, eval_ts, until, active), one row for all consecutive evaluations that
    see one value. Rules over single samples see the last one for ``lookback_seconds``, so a missed scrape does not end an
    alert."""
    key = F.to_json("labels")
    rows = samples.select("ts", "metric", "labels", "value", key.alias("series"))

    def points(part: DataFrame, on: list[str]) -> DataFrame:
        return evaluation_stretches(part, on, step_seconds, lookback_seconds)

    both = ["node_memory_MemTotal_bytes", "node_memory_MemAvailable_bytes"]
    memory = points(rows.filter(F.col("metric").isin(both)), ["series", "metric"])
    memory = _side_by_side_stretches(memory, ["series"], both, step_seconds).withColumnsRenamed(dict(zip(both, ("total", "free"))))
    down = points(match_labels(rows, "up", pattern={"job": "applications|observability"}), ["series"])

    def counter(metric: str, pattern: dict[str, str] | None, range_seconds: int) -> DataFrame:
        part = match_labels(rows, metric, pattern=pattern)
        per_step = (
            counter_deltas(part.select("series", "ts", "value"), ["series"])
            .groupBy("series", ((F.floor(F.unix_micros("ts") / (step_seconds * 1000000)) + 1) * step_seconds).alias("at"))
            .agg(F.sum("delta").alias("d"))
        )
        return rate_stretches(per_step, ["series"], range_seconds, step_seconds)

    def shaped(df: DataFrame, name: str, active: Column) -> DataFrame:
        times = [F.timestamp_seconds(c).alias(t) for c, t in (("first", "eval_ts"), ("last", "until"))]
        return df.select(F.lit(name).alias("alert"), "series", *times, F.coalesce(active, F.lit(False)).alias("active"))

    return (
        shaped(memory, "HighMemoryUsage", (F.col("total") - F.col("free")) / F.col("total") > MEMORY_LIMIT)
        .unionByName(shaped(counter("kube_pod_container_status_restarts_total", None, 3600), "PodRestartingFrequently", F.col("value") > RESTART_RATE_LIMIT))
        .unionByName(shaped(down, "ApplicationDown", F.col("value") == 0))
        .unionByName(shaped(counter("promhttp_metric_handler_requests_total", {"code": "4..|5.."}, 300), "HighErrorRate", F.col("value") > ERROR_RATE_LIMIT))
    )


def alert_intervals(
    conditions: DataFrame, keys: list[str], step_seconds: int = 30, hold_seconds: int | Column = 0, chunk: str = "hour"
) -> DataFrame:
    """Runs of consecutive true evaluations; a run held for long enough is firing from then on.

    A false or missing evaluation ends a run. A row is one evaluation or, with a column ``until``, all from ``eval_ts`` up to
    that one. Works on time chunks, so one noisy series is not one task.
    """
    until = F.col("until") if "until" in conditions.columns else F.col("eval_ts")
    true_rows = conditions.filter("active").select(*keys, "eval_ts", until.alias("until"))
    linked = with_previous(true_rows, keys, "eval_ts", F.struct("until"), "prev", chunk=chunk)
    gap = F.unix_micros("eval_ts") - F.unix_micros("prev.until")
    starts = F.when(F.col("prev").isNull() | (gap > step_seconds * 1000000), F.col("eval_ts"))
    runs = with_last_mark(linked, keys, "eval_ts", starts, "pending_from", chunk=chunk)
    hold = hold_seconds if isinstance(hold_seconds, Column) else F.lit(hold_seconds)
    steps = F.coalesce(F.floor((F.unix_seconds("until") - F.unix_seconds("eval_ts")) / step_seconds), F.lit(0)) + 1
    grouped = runs.groupBy(*keys, "pending_from").agg(F.max("until").alias("last_true"), F.sum(steps).alias("evaluations"))
    held = F.unix_seconds("last_true") - F.unix_seconds("pending_from") >= hold
    return grouped.withColumn("state", F.when(held, "firing").otherwise("pending")).withColumn(
        "firing_from", F.when(held, F.timestamp_seconds(F.unix_seconds("pending_from") + hold))
    )


def fire_alerts(samples: DataFrame, step_seconds: int = 30, lookback_seconds: int = 300) -> DataFrame:
    """All four rules to alert intervals with severity."""
    hold = F.create_map(*[F.lit(x) for n, h, _ in ALERT_RULES for x in (n, h)])
    severity = F.create_map(*[F.lit(x) for n, _, s in ALERT_RULES for x in (n, s)])
    runs = alert_intervals(
        alert_conditions(samples, step_seconds, lookback_seconds), ["alert", "series"], step_seconds, F.element_at(hold, F.col("alert"))
    )
    return runs.withColumn("severity", F.element_at(severity, F.col("alert")))
