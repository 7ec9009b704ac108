"""Checks: job events, logs, metrics, alerts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from checks.common import query, sql_stamp, stamp, table
from pricelake.operators import jobs, logs, metrics, ordered

_STAGES = ["view", "click", "signup", "purchase"]


def job_events(spark, sf):
    """Events as job events: the user's job per day, the event type is its stage."""
    return table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("job_id"),
        F.col("event_type").alias("stage"),
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("started").alias("event"),
        "ts",
        F.floor(F.col("value") / 10).cast("int").alias("retry"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        "event_id", "value",
    )


_JOBS = "jobs AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS job_id, * FROM events)"


@query("job_counters", f"""WITH {_JOBS}, s AS (SELECT job_id, bool_or(event_type = 'purchase') AS done, bool_or(event_type = 'error') AS bad FROM jobs GROUP BY job_id)
    SELECT count(*) AS submitted, count(*) FILTER (done OR bad) AS processed, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done AND bad) AS failed,
    count(*) FILTER (NOT done AND NOT bad) AS active FROM s""")
def job_counters(spark, sf):
    return jobs.job_counters(job_events(spark, sf))


@query("halving_average", """WITH o AS (SELECT event_type AS stage, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS b,
      row_number() OVER (ORDER BY ts DESC, event_id DESC) AS t FROM events)
    SELECT stage, round(sum(value * pow(2.0, -b)), 6) AS average, count(*) AS n FROM o GROUP BY stage
    UNION ALL SELECT NULL, round(sum(value * pow(2.0, -t)), 6), count(*) FROM o""")
def halving_average(spark, sf):
    rows = jobs.average_durations(job_events(spark, sf), ["stage"], "ts", "value", "event_id")
    return rows.select("stage", F.round("average", 6).alias("average"), "n")


@query("retry_report", f"""WITH {_JOBS}, s AS (SELECT job_id, max(floor(value / 10)::INT) AS retries, max_by(event_type, ts) AS last_stage,
      max_by(props, ts) FILTER (event_type = 'error') AS last_error, bool_or(event_type = 'purchase') AS done FROM jobs GROUP BY job_id)
    SELECT job_id, retries, last_stage, CASE WHEN done THEN 'COMPLETED' WHEN retries > 2 THEN 'FAILED' ELSE 'ACTIVE' END AS state FROM s""")
def retry_report(spark, sf):
    return jobs.retry_report(job_events(spark, sf)).select("job_id", "retries", "last_stage", "state")


@query("newest_completed", f"SELECT event_id, {sql_stamp('ts')} AS completed_at FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_completed(spark, sf):
    done = job_events(spark, sf).filter("event = 'completed'").withColumn("completed_at", F.col("ts"))
    return jobs.newest_completed(done, 50, tie="event_id").select("event_id", stamp("completed_at"))


# -- logs ------------------------------------------------------------------------------------
_PATHS = [
    "/var/log/containers/web-crawler-7_default_web-crawler-%s.log",
    "/var/log/containers/prom-1_observability_prometheus-%s.log",
    "/var/log/containers/pg-0_shared_postgres-%s.log",
    "/var/log/containers/traefik-5_kube-system_traefik-%s.log",
    "/var/log/containers/coredns-2_kube-system_coredns-%s.log",
    "/var/log/containers/other-9_web_nginx-%s.log",
]
_HASH = "ab" * 32


def container_lines(spark, sf):
    """Events as container log lines of six files."""
    files = F.array(*[F.lit(p % _HASH) for p in _PATHS])
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR Per stream rate limit exceeded "), "props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("rpc code = Code(429) "), "props"))
        .otherwise(F.concat(F.lit("GET /"), F.col("event_type"), F.lit(" HTTP/1.1")))
    )
    return table(spark, sf, "events").select(
        F.element_at(files, (F.col("user_id") % 6 + 1).cast("int")).alias("path"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(" stdout F "), text).alias("raw"),
    )


_ROUTE = "(['applications', 'observability', 'infrastructure', 'traffic', 'dns', NULL])[1 + user_id % 6]"
_POD = "(['default', 'observability', 'shared', 'kube-system', 'kube-system', 'web'])[1 + user_id % 6]"
_BOX = "(['web-crawler', 'prometheus', 'postgres', 'traefik', 'coredns', 'nginx'])[1 + user_id % 6]"
_LINE = "CASE event_type WHEN 'error' THEN 'ERROR Per stream rate limit exceeded ' || props WHEN 'click' THEN 'rpc code = Code(429) ' || props ELSE 'GET /' || event_type || ' HTTP/1.1' END"


@query("log_lines", f"""SELECT epoch_us(ts) AS us, 'stdout' AS stream, 'F' AS flags, {_LINE} AS line, {_ROUTE} AS job, {_POD} AS namespace, {_BOX} AS container FROM events""")
def log_lines(spark, sf):
    return logs.parse_lines(container_lines(spark, sf)).select(
        F.unix_micros("ts").alias("us"), "stream", "flags", "line", "job", "namespace", "container"
    )


@query("log_drops", """SELECT CASE event_type WHEN 'error' THEN 'rate_limit_feedback_loop' ELSE 'rate_limit_429_errors' END AS drop_reason, count(*) AS lines
    FROM events WHERE user_id % 6 = 1 AND event_type IN ('error', 'click') GROUP BY 1""")
def log_drops(spark, sf):
    return logs.drop_counts(logs.parse_lines(container_lines(spark, sf)))


@query("log_kept", f"""SELECT {_ROUTE} AS job, count(*) AS lines FROM events WHERE NOT (user_id % 6 = 1 AND event_type IN ('error', 'click')) GROUP BY 1""")
def log_kept(spark, sf):
    kept = logs.kept_lines(logs.parse_lines(container_lines(spark, sf)))
    return kept.groupBy("job").agg(F.count(F.lit(1)).alias("lines"))


def requests(spark, sf):
    """Events as access lines; path, client, method and status are read from the line."""
    methods = F.create_map(*[F.lit(x) for p in zip(["view", "click", "signup", "purchase", "error"], ["GET", "GET", "PUT", "POST", "DELETE"]) for x in p])
    status = F.when(F.col("event_type") == "error", F.when(F.col("value") > 30, 500).otherwise(404)).when(F.col("event_type") == "click", 302).otherwise(200)
    access = F.concat(
        F.col("user_id").cast("string"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"), F.lit('] "'), methods[F.col("event_type")],
        F.lit(" /k/"), F.get_json_object("props", "$.k"), F.lit('?from=list HTTP/1.1" '), status.cast("string"), F.lit(" "), F.col("event_id").cast("string"), F.lit(' "-" "-"'),
    )
    rows = table(spark, sf, "events").select("event_id", "ts", "event_type", "props", access.alias("raw"))
    return logs.access_fields(rows, "raw").select(
        "event_id", "ts", F.col("client").cast("bigint").alias("client"), "path", "method", "status", F.concat_ws(" ", "event_type", "props").alias("line"), "size",
    )


@query("access_fields", """SELECT event_id, user_id AS client, '/k/' || (props->>'$.k') AS path, event_id AS size FROM events UNION ALL SELECT -1 - event_id, NULL, NULL, NULL FROM events""")
def access_fields(spark, sf):
    """Access lines, and other lines that give nothing."""
    other = logs.access_fields(table(spark, sf, "events").select((-1 - F.col("event_id")).alias("event_id"), F.concat(F.lit("GET "), "props").alias("line")))
    return requests(spark, sf).select("event_id", "client", "path", "size").unionByName(other.select("event_id", F.col("client").cast("bigint").alias("client"), "path", "size"))


_REQ = """req AS (SELECT event_id, ts, user_id AS client, '/k/' || (props->>'$.k') AS path, CASE event_type WHEN 'signup' THEN 'PUT' WHEN 'purchase' THEN 'POST' WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method,
      CASE WHEN event_type = 'error' THEN CASE WHEN value > 30 THEN 500 ELSE 404 END WHEN event_type = 'click' THEN 302 ELSE 200 END AS status, event_type || ' ' || props AS line FROM events)"""
_WINDOW = lambda s: f"to_timestamp((epoch_us(ts) // 1000000) // {s} * {s}) AT TIME ZONE 'UTC'"


@query("count_over_time", f"""WITH {_REQ}, w AS (SELECT ts, unnest(range(6)) AS back FROM req WHERE contains(line, 'error') OR regexp_matches(line, 'click.*[05]'))
    SELECT (epoch_us(ts) // 1000000) // 600 * 600 - back * 600 AS start_s, count(*) AS n FROM w GROUP BY 1""")
def count_over_time(spark, sf):
    """One-hour windows sliding by ten minutes over filtered lines."""
    rows = requests(spark, sf)
    picked = logs.matching(rows, pattern="error|click.*[05]")
    return logs.count_over_time(picked, 3600, 600).select(F.unix_seconds("window_start").alias("start_s"), "n")


@query("noisiest_sources", f"WITH {_REQ} SELECT {sql_stamp(_WINDOW(86400))} AS window_start, path, count(*) AS n FROM req GROUP BY ALL")
def noisiest_sources(spark, sf):
    return logs.noisiest(requests(spark, sf), "path", 86400).select(stamp("window_start"), "path", "n")


@query("distinct_clients", f"WITH {_REQ} SELECT {sql_stamp(_WINDOW(3600))} AS window_start, count(DISTINCT client) AS n FROM req GROUP BY 1")
def distinct_clients(spark, sf):
    return logs.distinct_over_time(requests(spark, sf), "client", 3600).select(stamp("window_start"), "n")


@query("request_rate", f"WITH {_REQ} SELECT {sql_stamp(_WINDOW(3600))} AS window_start, method, count(*) AS n, round(count(*) / 3600.0, 8) AS per_second FROM req GROUP BY ALL")
def request_rate(spark, sf):
    rows = logs.rate(logs.count_over_time(requests(spark, sf), 3600, by=["method"]), 3600)
    return rows.select(stamp("window_start"), "method", "n", F.round("per_second", 8).alias("per_second"))


@query("status_classes", f"""WITH {_REQ} SELECT {sql_stamp(_WINDOW(3600))} AS window_start, round(count(*) FILTER (status // 100 = 2) / 3600.0, 8) AS rate_2xx,
    round(count(*) FILTER (status // 100 = 4) / 3600.0, 8) AS rate_4xx, round(count(*) FILTER (status // 100 = 5) / 3600.0, 8) AS rate_5xx FROM req GROUP BY 1""")
def status_classes(spark, sf):
    rows = logs.status_classes(requests(spark, sf), "status", 3600)
    return rows.select(stamp("window_start"), *[F.round(f"rate_{c}xx", 8).alias(f"rate_{c}xx") for c in (2, 4, 5)])


@query("method_counts", f"WITH {_REQ} SELECT {sql_stamp(_WINDOW(86400))} AS window_start, method, count(*) AS n FROM req GROUP BY ALL")
def method_counts(spark, sf):
    return logs.count_over_time(requests(spark, sf), 86400, by=["method"]).select(stamp("window_start"), "method", "n")


@query("top_paths", f"WITH {_REQ} SELECT path, count(*) AS n FROM req GROUP BY path ORDER BY n DESC, path LIMIT 10")
def top_paths(spark, sf):
    return logs.top_labels(requests(spark, sf), "path", 10)


@query("topk_per_window", f"""WITH {_REQ}, c AS (SELECT {sql_stamp(_WINDOW(86400))} AS window_start, client, count(*) AS n FROM req GROUP BY ALL)
    SELECT window_start, client, n, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, client) AS rank FROM c QUALIFY rank <= 10""")
def topk_per_window(spark, sf):
    return logs.top_labels_per_window(requests(spark, sf), "client", 86400, 10).select(stamp("window_start"), "client", "n", "rank")


@query("recent_errors", f"WITH {_REQ} SELECT event_id, {sql_stamp('ts')} AS ts, line FROM req WHERE regexp_matches(status::VARCHAR, '^[45]') ORDER BY req.ts DESC, event_id DESC LIMIT 100")
def recent_errors(spark, sf):
    bad = requests(spark, sf).filter(F.col("status").between(400, 599))
    return logs.recent_lines(bad, 100, tie="event_id").select("event_id", stamp("ts"), "line")


@query("heat_map", """WITH g AS (SELECT unnest(range(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11', INTERVAL 5 MINUTES)) AS bucket),
    c AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS bucket, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1)
    SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (bucket)""")
def heat_map(spark, sf):
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    return logs.heat_map(requests(spark, sf), day(10), day(11)).select(stamp("bucket"), "n")


@query("threshold_bands", f"""WITH {_REQ}, c AS (SELECT {sql_stamp(_WINDOW(86400))} AS window_start, count(*) AS n FROM req WHERE status >= 400 GROUP BY 1)
    SELECT window_start, n, CASE WHEN n >= 70 THEN 'red' WHEN n >= 60 THEN 'yellow' ELSE 'green' END AS band FROM c""")
def threshold_bands(spark, sf):
    rows = logs.count_over_time(requests(spark, sf).filter("status >= 400"), 86400)
    return rows.select(stamp("window_start"), "n", logs.threshold_colour(F.col("n"), 60, 70).alias("band"))


@query("lookback_rows", "SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-18' AND ts <= TIMESTAMP '2024-01-25'")
def lookback_rows(spark, sf):
    return logs.lookback(requests(spark, sf), datetime(2024, 1, 25), 7, 30).agg(F.count(F.lit(1)).alias("n"))


# -- metrics ---------------------------------------------------------------------------------
def counters(spark, sf):
    """Running sum of event values per event type, wrapped at 5000: a counter with resets."""
    rows = table(spark, sf, "events").select("event_id", "ts", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    total = ordered.running_total(rows, ["event_type"], "ts", F.col("cents"), "total", tie="event_id")
    return total.select("event_id", "ts", "event_type", (F.col("total") % 500000).cast("double").alias("value"))


_COUNTER = """c AS (SELECT event_id, ts, event_type, (sum(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id) % 500000)::DOUBLE AS value FROM events),
    d AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pts FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    g AS (SELECT *, CASE WHEN pv IS NULL THEN 0 WHEN value >= pv THEN value - pv ELSE value END AS delta FROM d)"""


@query("counter_increase", f"""WITH {_COUNTER} SELECT event_type, {sql_stamp(_WINDOW(3600))} AS window_start, round(sum(delta), 4) AS increase, round(sum(delta) / 3600.0, 6) AS rate FROM g GROUP BY ALL""")
def counter_increase(spark, sf):
    rows = metrics.increase(counters(spark, sf), ["event_type"], 3600, tie="event_id")
    return rows.select("event_type", stamp("window_start"), F.round("increase", 4).alias("increase"), F.round("rate", 6).alias("rate"))


@query("counter_irate", f"""WITH {_COUNTER}, s AS (SELECT *, (epoch_us(ts) // 1000000) // 14400 * 14400 AS w FROM g),
    l AS (SELECT event_type, w, max_by(CASE WHEN epoch_us(pts) >= w * 1000000 AND pts < ts THEN delta / ((epoch_us(ts) - epoch_us(pts)) / 1000000.0) END, (ts, event_id)) AS irate FROM s GROUP BY ALL)
    SELECT event_type, w, round(irate, 4) AS irate FROM l WHERE irate IS NOT NULL""")
def counter_irate(spark, sf):
    rows = metrics.instant_rate(counters(spark, sf), ["event_type"], 14400, tie="event_id")
    return rows.select("event_type", F.unix_seconds("window_start").alias("w"), F.round("irate", 4).alias("irate"))


def gauges(spark, sf):
    """Events as gauge samples: the user is the instance, the event type is the metric."""
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("event_type").alias("metric"), "value",
        F.create_map(
            F.lit("instance"), F.col("user_id").cast("string"), F.lit("zone"), F.concat(F.lit("z"), (F.col("user_id") % 4).cast("string"))
        ).alias("labels"),
    )


@query("instant_sum_by", """WITH l AS (SELECT user_id, 'z' || user_id % 4 AS zone, max_by(value, (ts, event_id)) AS v FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT zone, round(sum(v), 4) AS sum_value, round(avg(v), 4) AS avg_value, count(*) AS series FROM l GROUP BY zone""")
def instant_sum_by(spark, sf):
    rows = metrics.label_columns(metrics.match_labels(gauges(spark, sf), "view"), ["instance", "zone"]).withColumn("event_id", F.lit(0))
    out = metrics.instant_by(rows, ["instance", "zone"], ["zone"])
    return out.select("zone", F.round("sum_value", 4).alias("sum_value"), F.round("avg_value", 4).alias("avg_value"), "series")


@query("metric_ratio", """WITH l AS (SELECT user_id, max_by(value, (ts, event_id)) FILTER (event_type = 'view') AS total, max_by(value, (ts, event_id)) FILTER (event_type = 'click') AS free FROM events GROUP BY user_id)
    SELECT user_id::VARCHAR AS instance, round((total - free) / total * 100, 4) AS used_pct FROM l WHERE total IS NOT NULL AND free IS NOT NULL""")
def metric_ratio(spark, sf):
    rows = gauges(spark, sf).select("event_id", "ts", "metric", "value", F.col("labels")["instance"].alias("instance"))
    wide = metrics.side_by_side(rows, ["instance"], ["view", "click"], tie="event_id")
    used = metrics.used_percent(F.col("view"), F.col("click"))
    return wide.select("instance", F.round(used, 4).alias("used_pct")).filter(F.col("used_pct").isNotNull())


@query("label_matchers", """SELECT event_type AS metric, count(*) AS n FROM events WHERE event_type IN ('view', 'error') AND user_id % 4 <> 2 AND regexp_full_match(user_id::VARCHAR, '1.*|7') GROUP BY 1""")
def label_matchers(spark, sf):
    rows = metrics.match_labels(gauges(spark, sf), unequal={"zone": "z2"}, pattern={"instance": "1.*|7"})
    return rows.filter(F.col("metric").isin("view", "error")).groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


@query("metric_topk", f"""WITH {_COUNTER}, r AS (SELECT event_type, (epoch_us(ts) // 1000000) // 86400 * 86400 AS w, sum(delta) / 86400.0 AS rate FROM g GROUP BY ALL)
    SELECT event_type AS pod, strftime(to_timestamp(w) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS day, round(sum(rate), 6) AS cpu FROM r GROUP BY ALL ORDER BY cpu DESC, pod, day LIMIT 10""")
def metric_topk(spark, sf):
    rates = metrics.increase(counters(spark, sf), ["event_type"], 86400, tie="event_id")
    top = metrics.top_series(rates, "rate", ["event_type", "window_start"], 10, {"event_type": "pod", "window_start": "day", "rate": "cpu"})
    return top.select("pod", stamp("day"), "cpu")


@query("relabelled", """SELECT user_id % 4 AS zone_no, count(*) AS n, count(DISTINCT user_id) AS targets FROM events WHERE user_id % 4 <> 3 GROUP BY 1""")
def relabelled(spark, sf):
    kept = metrics.relabel_keep(gauges(spark, sf), ["zone"], "z[0-2]")
    named = metrics.relabel_replace(kept, ["instance", "zone"], "address", r"(\d+);z(\d+)", "$1:$2")
    address = F.col("labels")["address"]
    return named.groupBy(F.substring_index(address, ":", -1).cast("bigint").alias("zone_no")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(address).alias("targets")
    )


_POINTS = """p AS (SELECT event_type, ((epoch_us(ts) // 1000000) // 3600 + 1) * 3600 AS e, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL),
    t AS (SELECT event_type, e, e - 3600 * row_number() OVER (PARTITION BY event_type ORDER BY e) AS island FROM p WHERE value > 15),
    runs AS (SELECT event_type, min(e) AS a, max(e) AS b, count(*) AS n FROM t GROUP BY event_type, island)"""


@query("alert_intervals", f"""WITH {_POINTS} SELECT event_type, a AS pending_s, b AS last_s, n AS evaluations, CASE WHEN b - a >= 7200 THEN 'firing' ELSE 'pending' END AS state,
    CASE WHEN b - a >= 7200 THEN a + 7200 END AS firing_s FROM runs""")
def alert_intervals(spark, sf):
    points = metrics.evaluation_points(table(spark, sf, "events"), ["event_type"], 3600, tie="event_id")
    runs = metrics.alert_intervals(points.withColumn("active", F.col("value") > 15), ["event_type"], 3600, 7200, chunk="day")
    return runs.select(
        "event_type", F.unix_seconds("pending_from").alias("pending_s"), F.unix_seconds("last_true").alias("last_s"),
        "evaluations", "state", F.unix_seconds("firing_from").alias("firing_s"),
    )


# each user's events are samples of all metrics; a slow and a steep counter follow the clock
_RULES = """e AS (SELECT user_id AS u, event_id, ts, epoch_us(ts) / 1e6 AS t, value, (epoch_us(ts) // 30000000 + 1) * 30 AS st FROM events WHERE event_type = 'view'),
    p AS (SELECT u, st, max_by(value, (ts, event_id)) AS v, max(t) AS seen FROM e GROUP BY u, st),
    q AS (SELECT *, least(coalesce(lead(st) OVER (PARTITION BY u ORDER BY st) - 30, (SELECT max(st) FROM p)), floor((seen + 300) / 30) * 30) AS upto FROM p),
    i AS (SELECT u, v, unnest(range(st, greatest(st, upto)::BIGINT + 1, 30)) AS st FROM q),
    c AS (SELECT u, st, unnest([u % 3, u % 5]) AS k, unnest(['PodRestartingFrequently', 'HighErrorRate']) AS alert, unnest([3600, 300]) AS span, unnest([0.5, 0.1]) AS most,
      floor(t * 1000) / 1000 - lag(floor(t * 1000) / 1000) OVER (PARTITION BY u ORDER BY t) AS d FROM e),
    s AS (SELECT alert, u, span, most, st, sum(d * k) AS d FROM c WHERE d IS NOT NULL GROUP BY ALL),
    r AS (SELECT alert, u, x AS st, sum(d) / any_value(span) AS v, any_value(most) AS most FROM (SELECT *, unnest(range(st, st + span, 30)) AS x FROM s) GROUP BY alert, u, x),
    a AS (SELECT 'ApplicationDown' AS alert, u, st FROM i WHERE v < 5 UNION ALL SELECT 'HighMemoryUsage', u, st FROM i WHERE v < 15
      UNION ALL SELECT alert, u, st FROM r WHERE v > most),
    f AS (SELECT *, CASE WHEN st - lag(st) OVER (PARTITION BY alert, u ORDER BY st) = 30 THEN 0 ELSE 1 END AS fresh FROM a),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY alert, u ORDER BY st ROWS UNBOUNDED PRECEDING) AS run FROM f),
    runs AS (SELECT alert, u, max(st) - min(st) AS held, count(*) AS n FROM g GROUP BY alert, u, run)"""


@query("alert_rules", f"""WITH {_RULES} SELECT alert, CASE alert WHEN 'ApplicationDown' THEN 'critical' ELSE 'warning' END AS severity,
    CASE WHEN held >= CASE alert WHEN 'HighMemoryUsage' THEN 300 WHEN 'ApplicationDown' THEN 60 ELSE 120 END THEN 'firing' ELSE 'pending' END AS state,
    count(*) AS runs, CAST(sum(n) AS BIGINT) AS evaluations FROM runs GROUP BY ALL""")
def alert_rules(spark, sf):
    """All four rules: views as irregular samples of up, memory and two counters."""
    user = F.col("user_id")
    clock = F.floor(F.unix_micros("ts") / 1000) / 1000
    metrics_of = F.array(
        F.struct(F.lit("up").alias("metric"), F.when(F.col("value") < 5, 0.0).otherwise(1.0).alias("value")),
        F.struct(F.lit("node_memory_MemTotal_bytes").alias("metric"), F.lit(100.0).alias("value")),
        F.struct(F.lit("node_memory_MemAvailable_bytes").alias("metric"), F.col("value")),
        F.struct(F.lit("kube_pod_container_status_restarts_total").alias("metric"), (clock * (user % 3)).alias("value")),
        F.struct(F.lit("promhttp_metric_handler_requests_total").alias("metric"), (clock * (user % 5)).alias("value")),
    )
    labels = F.create_map(F.lit("job"), F.lit("applications"), F.lit("code"), F.lit("500"), F.lit("instance"), user.cast("string"))
    rows = table(spark, sf, "events").filter("event_type = 'view'").select("ts", labels.alias("labels"), F.explode(metrics_of).alias("m"))
    return metrics.fire_alerts(rows.select("ts", "labels", "m.*")).groupBy("alert", "severity", "state").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("evaluations").alias("evaluations")
    )
