"""Streams give the same rows as the batch operators on the same input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricelake.functions import urls
from pricelake.operators import logs, metrics, serp, store
from pricelake.sources.tables import read_table
from pricelake.streaming import stateful, upsert, windows
from tests.conftest import SMALL


def split_files(df, folder, parts, order):
    """Write rows as several files in time order, so that a stream reads several batches."""
    rows = df.orderBy(order)
    total = rows.count()
    numbered = rows.rdd.zipWithIndex().map(lambda r: (*r[0], r[1])).toDF(df.schema.add("__n", "long"))
    for i in range(parts):
        part = numbered.filter((F.col("__n") >= total * i // parts) & (F.col("__n") < total * (i + 1) // parts)).drop("__n")
        part.coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, df, folder, parts=3, order="ts"):
    split_files(df, folder, parts, order)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, folder, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", folder).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def events(spark):
    return read_table(spark, f"{SMALL}/events.parquet")


def test_live_counts(spark, tmp_path):
    rows = events(spark)
    stream = stream_of(spark, rows, str(tmp_path / "in"))
    got = run(windows.live_counts(stream, 3600, 1800, ["event_type"], delay="0 seconds"), str(tmp_path / "c"), "live_counts")
    want = logs.count_over_time(rows, 3600, 1800, ["event_type"])
    # windows that the watermark has not passed yet are still open
    done = got.agg(F.max("window_end")).first()[0]
    a = {tuple(r) for r in got.collect()}
    b = {tuple(r) for r in want.filter(F.col("window_end") <= F.lit(done)).collect()}
    assert a == b and len(a) > 100


def test_live_distinct(spark, tmp_path):
    rows = events(spark)
    got = run(windows.live_distinct(stream_of(spark, rows, str(tmp_path / "in")), "user_id", 86400, "0 seconds"), str(tmp_path / "c"), "live_distinct")
    want = {r.window_start: r.n for r in logs.distinct_over_time(rows, "user_id", 86400).collect()}
    for r in got.collect():
        assert abs(r.n - want[r.window_start]) <= max(3, 0.1 * want[r.window_start])


def test_late_rows(spark, tmp_path):
    rows = events(spark).withColumn("ingest_ts", F.lit("2024-01-20").cast("timestamp"))
    kept, refused = windows.split_late(stream_of(spark, rows, str(tmp_path / "in")))
    a = run(kept.select("event_id"), str(tmp_path / "c1"), "late_kept").count()
    b = run(refused.select("event_id"), str(tmp_path / "c2"), "late_refused").count()
    want = rows.filter("ts < TIMESTAMP '2024-01-13'").count()
    assert (a, b) == (rows.count() - want, want) and want > 0


def test_seen_urls(spark, tmp_path):
    rows = events(spark).select("ts", F.concat(F.lit("https://www.a.com/"), F.col("user_id").cast("string"), F.when(F.col("value") > 20, "?ref=x").otherwise("/")).alias("url"))
    got = run(windows.suppress_seen(stream_of(spark, rows, str(tmp_path / "in")), delay="60 days"), str(tmp_path / "c"), "seen_urls")
    want = rows.select(urls.normalize(F.col("url"))).distinct().count()
    assert got.count() == want == got.select("norm_url").distinct().count()


def test_upsert_stream(spark, tmp_path):
    rows = events(spark).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("title"), F.col("props").alias("full_text"), F.col("ts").alias("fetched_at")
    )
    empty = rows.limit(0).select("url", "title", "full_text", F.col("fetched_at").alias("crawled_at"), F.col("fetched_at").alias("last_updated"))
    versions = str(tmp_path / "versions")
    query = upsert.land_versions(stream_of(spark, rows, str(tmp_path / "in"), order="fetched_at"), versions, str(tmp_path / "c"))
    query.awaitTermination(180)
    assert query.exception() is None
    columns = ["url", "title", "full_text", "crawled_at", "last_updated"]
    got = {tuple(r) for r in upsert.current(empty, versions).select(columns).collect()}
    (tmp_path / "versions" / "part-left-by-a-lost-task.parquet").write_bytes(b"no parquet")  # not in the sink's log
    assert {tuple(r) for r in upsert.current(empty, versions).select(columns).collect()} == got
    want = {tuple(r) for r in store.upsert_pages(empty, rows).select("url", "title", "full_text", "crawled_at", "last_updated").collect()}
    assert got == want


def fetch_log(spark):
    return events(spark).select(
        F.when(F.col("user_id") % 2 == 0, "ecosia").otherwise("qwant").alias("engine"), "ts",
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("outcome"),
        F.floor(F.col("value") * 1000).alias("html_len"), F.when(F.col("event_type") == "click", 0).otherwise(3).alias("hits"),
        (F.col("event_type") == "click").alias("blocked"),
    )


def test_blocked_sessions(spark, tmp_path):
    rows = fetch_log(spark)
    got = run(windows.blocked_sessions(stream_of(spark, rows, str(tmp_path / "in")), "2 hours", "0 seconds"), str(tmp_path / "c"), "blocked_sessions")
    want = windows.blocked_sessions(rows, "2 hours", "0 seconds")
    a, b = {tuple(r) for r in got.collect()}, {tuple(r) for r in want.collect()}
    assert a <= b and len(b) - len(a) <= 2 and len(a) > 20


try:
    import google.protobuf  # noqa: F401

    has_protobuf = True
except ImportError:
    has_protobuf = False
needs_protobuf = pytest.mark.skipif(not has_protobuf, reason="stateful Python processors need protobuf")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


@needs_protobuf
def test_breaker_stream(spark, tmp_path, rocks):
    rows = fetch_log(spark)
    got = run(stateful.breaker_changes(stream_of(spark, rows, str(tmp_path / "in")), 7200), str(tmp_path / "c"), "breaker_changes")
    last = {}
    for r in sorted(got.collect(), key=lambda r: r["at"]):
        assert last.get(r.engine) != r.state  # open and closed take turns
        last[r.engine] = r.state
    state = serp.breaker_state(rows, F.lit("2024-12-01").cast("timestamp"), 7200)
    assert got.count() > 50 and state.filter("is_open").count() == 0


@needs_protobuf
def test_alert_stream(spark, tmp_path, rocks):
    points = metrics.evaluation_points(events(spark), ["event_type"], 3600, tie="event_id")
    rows = points.select(
        F.lit("Busy").alias("alert"), F.col("event_type").alias("series"), "eval_ts", (F.col("value") > 8).alias("active"), F.lit(3600).alias("hold_seconds")
    )
    got = run(stateful.alert_changes(stream_of(spark, rows, str(tmp_path / "in"), order="eval_ts"), 3600, "0 seconds"), str(tmp_path / "c"), "alert_changes")
    runs = metrics.alert_intervals(rows, ["alert", "series"], 3600, 3600, chunk="day")
    pending = {(r.series, r["at"]) for r in got.filter("state = 'pending'").collect()}
    firing = {(r.series, r["at"]) for r in got.filter("state = 'firing'").collect()}
    assert pending == {(r.series, r.pending_from) for r in runs.collect()}
    assert firing == {(r.series, r.firing_from) for r in runs.filter("state = 'firing'").collect()} and firing
