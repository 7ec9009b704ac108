"""Checks of the streaming jobs: runs over all of ``events``, as batch where the job allows it, else as a stream that takes
what is there and stops, into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.common import query, sql_stamp, stamp, table
from checks.intake import _BREAKER, fetch_log
from checks.store import versions
from pricelake.operators import metrics
from pricelake.session import shared_folder
from pricelake.streaming import stateful, upsert, windows


@query("stream_late_rows", "SELECT event_id, ts >= TIMESTAMP '2024-01-13' AS kept FROM events")
def stream_late_rows(spark, sf):
    rows = table(spark, sf, "events").withColumn("ingest_ts", F.lit("2024-01-20").cast("timestamp"))
    kept, refused = windows.split_late(rows)
    return kept.select("event_id", F.lit(True).alias("kept")).union(refused.select("event_id", F.lit(False)))


@query("stream_live_counts", """WITH e AS (SELECT event_type, epoch_us(ts) // 1800000000 * 1800 - 1800 * k AS s FROM events, (SELECT unnest([0, 1]) AS k))
    SELECT event_type, s AS window_s, count(*) AS n FROM e GROUP BY ALL""")
def stream_live_counts(spark, sf):
    counts = windows.live_counts(table(spark, sf, "events"), 3600, 1800, ["event_type"])
    return counts.select("event_type", F.unix_seconds("window_start").alias("window_s"), "n")


def arriving(rows, name):
    """Rows as a stream that reads a folder of them, and a folder for its result."""
    folder = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    return rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder


def landed(stream, folder):
    """Run the stream over what is there and read its result."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    writer.format("parquet").start(f"{folder}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_seen_urls", "SELECT DISTINCT 'http' || 's://a.com/' || user_id AS norm_url FROM events")
def stream_seen_urls(spark, sf):
    """Two spellings of each user's URL; one row stays."""
    rows = table(spark, sf, "events").select(
        "ts", F.concat(F.lit("https://www.a.com/"), F.col("user_id").cast("string"), F.when(F.col("value") > 20, "?utm_source=x").otherwise("/")).alias("url")
    )
    stream, folder = arriving(rows, "seen")
    return landed(windows.suppress_seen(stream, delay="60 days"), folder).select("norm_url")


@query("stream_blocked_sessions", f"""WITH {_BREAKER.replace("WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'", "")},
    o AS (SELECT engine, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY engine ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM ev WHERE event = 'open'),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY engine ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM o)
    SELECT engine, min(t) AS from_us, max(t) + 7200000000 AS until_us, count(*) AS fetches FROM r GROUP BY engine, run""")
def stream_blocked_sessions(spark, sf):
    runs = windows.blocked_sessions(fetch_log(spark, sf), "2 hours", min_chars=2000)
    return runs.select("engine", F.unix_micros("blocked_from").alias("from_us"), F.unix_micros("blocked_until").alias("until_us"), "fetches")


@query("stream_page_upsert", f"""SELECT 'https://site.example.com/' || user_id AS url, max_by(event_type, ts) AS title, max_by(props, ts) AS full_text,
    {sql_stamp('min(ts)')} AS crawled_at, {sql_stamp('CASE WHEN count(*) > 1 THEN max(ts) END')} AS last_updated FROM events GROUP BY user_id""")
def stream_page_upsert(spark, sf):
    """Page versions land as a stream over a base that holds the first half of them."""
    rows, cut = versions(spark, sf), F.lit("2024-01-15").cast("timestamp")
    stream, folder = arriving(rows.filter(F.col("fetched_at") >= cut), "upsert")
    empty = rows.limit(0).select("url", "title", "full_text", F.col("fetched_at").alias("crawled_at"), F.col("fetched_at").alias("last_updated"))
    base = upsert.upsert_pages(empty, rows.filter(F.col("fetched_at") < cut))
    upsert.land_versions(stream, f"{folder}/versions", f"{folder}/progress").awaitTermination()
    return upsert.current(base, f"{folder}/versions").select("url", "title", "full_text", stamp("crawled_at"), stamp("last_updated"))


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_run(spark, stream, folder):
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKS)
    try:
        return landed(stream, folder)
    finally:
        spark.conf.set(_STATE_STORE, before)


@query("stream_breaker_states", f"""WITH {_BREAKER.replace("WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'", "")},
    e AS (SELECT engine, epoch_us(ts) AS t, event, lag(event) OVER w AS was, lag(epoch_us(ts)) OVER w AS before, lead(epoch_us(ts)) OVER w AS next FROM ev WHERE event <> 'none' WINDOW w AS (PARTITION BY engine ORDER BY ts)),
    c AS (SELECT engine, 'open' AS state, t FROM e WHERE event = 'open' AND NOT coalesce(was = 'open' AND t - before < 7200000000, false) UNION ALL
      SELECT engine, 'closed', t FROM e WHERE event = 'close' AND was = 'open' AND t - before < 7200000000 UNION ALL
      SELECT engine, 'closed', t + 7200000000 FROM e WHERE event = 'open' AND (next - t >= 7200000000 OR next IS NULL AND t + 7200000000 < (SELECT max(t) FROM e) - 60000000))
    SELECT engine, state, t AS at_us FROM c""")
def stream_breaker_states(spark, sf):
    """All changes; an engine open at the end closes if its time is up when the watermark stops."""
    stream, folder = arriving(fetch_log(spark, sf), "breaker")
    return stateful_run(spark, stateful.breaker_changes(stream, 7200, min_chars=2000), folder).select("engine", "state", F.unix_micros("at").alias("at_us"))


@query("stream_alert_states", f"""WITH p AS (SELECT event_type, (epoch_us(ts) // 3600000000 + 1) * 3600 AS e, max_by(value, (ts, event_id)) AS v FROM events GROUP BY ALL),
    o AS (SELECT event_type, e, CASE WHEN e - lag(e) OVER (PARTITION BY event_type ORDER BY e) = 3600 THEN 0 ELSE 1 END AS fresh FROM p WHERE v > 8),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY e ROWS UNBOUNDED PRECEDING) AS run FROM o),
    r AS (SELECT event_type, min(e) AS a, max(e) AS b FROM g GROUP BY event_type, run),
    c AS (SELECT event_type, 'pending' AS state, a AS t FROM r UNION ALL SELECT event_type, 'firing', a + 3600 FROM r WHERE b - a >= 3600
      UNION ALL SELECT event_type, 'resolved', b + 3600 FROM r JOIN (SELECT event_type, max(e) AS last FROM p GROUP BY event_type) USING (event_type)
        WHERE b - a >= 3600 AND (b < last OR b + 3600 < (SELECT max(e) FROM p)))
    SELECT event_type AS series, state, t AS at_s FROM c""")
def stream_alert_states(spark, sf):
    """All changes; an alert that fires at the end is resolved if the watermark passes its last step."""
    points = metrics.evaluation_points(table(spark, sf, "events"), ["event_type"], 3600, tie="event_id")
    rows = points.select(
        F.lit("Busy").alias("alert"), F.col("event_type").alias("series"), "eval_ts", (F.col("value") > 8).alias("active"), F.lit(3600).alias("hold_seconds")
    )
    stream, folder = arriving(rows, "alerts")
    return stateful_run(spark, stateful.alert_changes(stream, 3600, "0 seconds"), folder).select("series", "state", F.unix_seconds("at").alias("at_s"))
