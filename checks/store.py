"""Checks: page store, page fields, time-to-live tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from checks import urlsql as U
from checks.common import query, sql_stamp, stamp, table
from pricelake.operators import pages as page_ops
from pricelake.operators import store
from pricelake.session import shared_folder
from pricelake.sources import pages as page_source


@query("pages_scan", f"SELECT 'https://site.example.com/e/' || event_id AS url, event_type AS title, props AS main_content, {sql_stamp('ts')} AS crawled_at FROM events")
def pages_scan(spark, sf):
    """Pages written by crawl date and read back."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    page_source.write_pages(stored_pages(spark, sf), folder)
    return page_source.read_pages(spark, folder).select("url", "title", "main_content", stamp("crawled_at"))


@query("page_clear", "SELECT count(*) AS before, 0::BIGINT AS after, 18 AS columns FROM events")
def page_clear(spark, sf):
    """A cleared table keeps its columns."""
    pages, folder = stored_pages(spark, sf), f"{shared_folder(spark)}/clear-{uuid.uuid4().hex}"
    pages.write.parquet(folder)
    before = spark.read.parquet(folder).count()
    store.clear_table(pages, folder)
    left = spark.read.parquet(folder)
    return left.agg(F.lit(before).alias("before"), F.count(F.lit(1)).alias("after"), F.lit(len(left.columns)).alias("columns"))


def versions(spark, sf):
    """Events as page versions: one page per user, one version per event."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("https://site.example.com/"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_type").alias("title"),
        F.col("props").alias("full_text"),
        F.col("ts").alias("fetched_at"),
    )


@query("page_upsert", f"""SELECT 'https://site.example.com/' || user_id AS url, max_by(event_type, ts) AS title, max_by(props, ts) AS full_text,
    {sql_stamp('min(ts)')} AS crawled_at, {sql_stamp('CASE WHEN count(*) > 1 THEN max(ts) END')} AS last_updated FROM events GROUP BY user_id""")
def page_upsert(spark, sf):
    rows = versions(spark, sf)
    empty = rows.limit(0).select(
        "url", "title", "full_text", F.col("fetched_at").alias("crawled_at"), F.col("fetched_at").alias("last_updated")
    )
    cut = F.lit("2024-01-15").cast("timestamp")
    base = store.upsert_pages(empty, rows.filter(F.col("fetched_at") < cut))
    return store.upsert_pages(base, rows.filter(F.col("fetched_at") >= cut)).select(
        "url", "title", "full_text", stamp("crawled_at"), stamp("last_updated")
    )


@query("page_merge_buckets", f"""SELECT 'https://site.example.com/' || user_id AS url, max_by(event_type, ts) AS title, {sql_stamp('min(ts)')} AS crawled_at,
    {sql_stamp('CASE WHEN count(*) > 1 THEN max(ts) END')} AS last_updated FROM events GROUP BY user_id""")
def page_merge_buckets(spark, sf):
    """A table of page versions in two parts, and the current page of each URL."""
    rows, folder, cut = versions(spark, sf), f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", F.lit("2024-01-15").cast("timestamp")
    for part in (F.col("fetched_at") < cut, F.col("fetched_at") >= cut):
        store.append_versions(rows.filter(part), folder)
    return store.current_pages(spark, folder).select("url", "title", stamp("crawled_at"), stamp("last_updated"))


@query("page_row_times", f"SELECT o_orderkey, {sql_stamp('o_orderdate')} AS from_http, {sql_stamp('o_orderdate')} AS from_iso, NULL::VARCHAR AS from_text FROM orders")
def page_row_times(spark, sf):
    """Header times of page rows: HTTP form, ISO form, and text that is no time."""
    orders = table(spark, sf, "orders")
    http = F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return orders.select(
        "o_orderkey",
        stamp(page_ops.parse_http_time(http), "from_http"),
        stamp(page_ops.parse_http_time(iso), "from_iso"),
        stamp(page_ops.parse_http_time(F.col("o_orderpriority")), "from_text"),
    )


def stored_pages(spark, sf):
    """Events in the shape of stored pages."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("https://site.example.com/e/"), F.col("event_id").cast("string")).alias("url"),
        F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("html"),
        F.col("event_type").alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.col("props").alias("main_content"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("full_text"),
        F.create_map(F.lit("h1"), F.array("event_type")).alias("headers"),
        F.create_map(F.lit("author"), F.col("user_id").cast("string")).alias("meta_tags"),
        F.array("props").alias("structured_data"),
        F.array(F.lit("https://site.example.com/")).alias("links"),
        F.array(F.struct(F.lit("a.png").alias("src"), F.col("event_type").alias("alt"), F.lit("").alias("title"))).alias("images"),
        F.lit("es").alias("content_language"),
        F.lit(None).cast("timestamp").alias("last_modified"),
        F.col("ts").alias("crawled_at"),
        F.lit(None).cast("timestamp").alias("last_updated"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


@query("page_export", """SELECT 'https://site.example.com/e/' || event_id AS url, CASE WHEN event_type = 'view' THEN props ELSE event_type END AS text,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS crawled_at, props AS meta_main, user_id::VARCHAR AS author FROM events""")
def page_export(spark, sf):
    records = page_source.export_json(stored_pages(spark, sf))
    field = lambda path: F.get_json_object("record", path)
    return records.select(
        "url", field("$.text").alias("text"), field("$.crawled_at").alias("crawled_at"),
        field("$.metadata.main_content").alias("meta_main"), field("$.metadata.meta_tags.author").alias("author"),
    )


@query("page_import", """SELECT 'https://site.example.com/e/' || event_id AS url, event_type AS title, props AS main_content, user_id::VARCHAR AS author,
    event_type AS alt, epoch_us(ts) AS crawled_us FROM events""")
def page_import(spark, sf):
    rows = page_source.import_json(page_source.export_json(stored_pages(spark, sf)))
    return rows.select(
        "url", "title", "main_content", F.col("meta_tags")["author"].alias("author"),
        F.col("images")[0]["alt"].alias("alt"), F.unix_micros("crawled_at").alias("crawled_us"),
    )


def document_pages(spark, sf):
    """Documents in the shape of stored pages."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("title"),
        F.col("lang").alias("description"),
        F.col("text").alias("main_content"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("text")).alias("full_text"),
        F.create_map(F.lit("h1"), F.array("source")).alias("headers"),
        F.array().cast("array<string>").alias("structured_data"),
        F.col("lang").alias("content_language"),
        F.lit(None).cast("timestamp").alias("last_modified"),
    )


def requested_urls(spark, sf):
    """Each labelled document and one that may not exist."""
    labels = table(spark, sf, "labels")
    return labels.select(
        F.explode(F.array("doc_id", F.col("doc_id") + 500)).alias("id")
    ).select(F.concat(F.lit("https://docs.example.com/"), F.col("id").cast("string")).alias("url")).distinct()


_REQUESTED = """req AS (SELECT DISTINCT 'https://docs.example.com/' || id AS url FROM (SELECT unnest([doc_id, doc_id + 500]) AS id FROM labels)),
    docs AS (SELECT 'https://docs.example.com/' || doc_id AS url, * FROM documents)"""


@query("page_context", f"""WITH {_REQUESTED} SELECT url, source AS title, lang AS description, md5(text) AS content, lang AS content_language
    FROM docs WHERE url IN (SELECT url FROM req)""")
def page_context(spark, sf):
    return store.context_pages(requested_urls(spark, sf), document_pages(spark, sf)).select(
        "url", "title", "description", F.md5("main_content").alias("content"), "content_language"
    )


@query("page_lookup", f"""WITH {_REQUESTED} SELECT url, source AS title, length(text) AS chars,
    CASE WHEN source IS NULL THEN 'not_found' ELSE 'found' END AS status FROM req LEFT JOIN docs USING (url)""")
def page_lookup(spark, sf):
    return store.lookup_pages(requested_urls(spark, sf), document_pages(spark, sf)).select(
        "url", "title", F.length("text").alias("chars"), "status"
    )


@query("page_lookup_counts", f"WITH {_REQUESTED} SELECT count(*) AS requested, count(source) AS found FROM req LEFT JOIN docs USING (url)")
def page_lookup_counts(spark, sf):
    return store.lookup_counts(store.lookup_pages(requested_urls(spark, sf), document_pages(spark, sf)))


@query("page_batches", """SELECT url, rn - 1 AS row_index, (rn - 1) // 100 AS batch FROM
    (SELECT 'https://docs.example.com/' || doc_id AS url, row_number() OVER (ORDER BY 'https://docs.example.com/' || doc_id) AS rn FROM documents)""")
def page_batches(spark, sf):
    return store.ordered_batches(document_pages(spark, sf).select("url"), "url", 100)


_AS_OF = datetime(2024, 1, 30)


@query("retention_counts", """SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-23') AS deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-23') AS kept FROM events""")
def retention_counts(spark, sf):
    return store.retention_counts(stored_pages(spark, sf), _AS_OF, 7)


@query("retention_kept", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS pages FROM events WHERE ts >= TIMESTAMP '2024-01-23' GROUP BY 1""")
def retention_kept(spark, sf):
    kept = store.retain_pages(stored_pages(spark, sf), _AS_OF, 7)
    return kept.groupBy(F.date_format("crawled_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("pages"))


@query("retention_folders", """WITH k AS (SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-23 12:00:00') AS deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-23 12:00:00') AS kept FROM events)
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS pages, deleted, kept FROM events, k WHERE ts >= TIMESTAMP '2024-01-23 12:00:00' GROUP BY ALL""")
def retention_folders(spark, sf):
    """Pages written by day; whole days are dropped by folder, and the day of the cutoff is written again."""
    folder = f"{shared_folder(spark)}/retention-{uuid.uuid4().hex}"
    page_source.write_pages(stored_pages(spark, sf), folder)
    deleted, kept = store.delete_old_folders(spark, folder, datetime(2024, 1, 30, 12), 7)
    left = spark.read.parquet(folder).groupBy(F.date_format("crawled_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("pages"))
    return left.withColumns({"deleted": F.lit(deleted).cast("bigint"), "kept": F.lit(kept).cast("bigint")})


@query("payload_slim", """SELECT url, length(html) AS html_len, length(html) AS screenshot_len, substr(html, 1, 120) AS screenshot_head,
    len(l) AS total, array_to_string(l[:5], ' ') AS first_results
    FROM (SELECT *, regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1) AS l FROM pages)""")
def payload_slim(spark, sf):
    links = F.regexp_extract_all("html", F.lit("""(?i)href=["']([^"']+)["']"""), 1)
    rows = table(spark, sf, "pages").withColumn("screenshot", F.col("html")).withColumn("results", links)
    return page_ops.slim_payload(rows).withColumn("first_results", F.array_join("first_results", " "))


# -- page fields -----------------------------------------------------------------------------
_UNESCAPE = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


def page_fields(spark, sf, *wanted):
    return page_ops.extract_fields(table(spark, sf, "pages"), fields=list(wanted))


@query("page_titles", f"SELECT url, trim({_UNESCAPE.format('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}) AS title FROM pages")
def page_titles(spark, sf):
    return page_fields(spark, sf, "title").select("url", "title")


@query("page_headings", f"""SELECT url, 'h1' AS level, 0 AS pos, trim({_UNESCAPE.format('''regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)''')}) AS text FROM pages""")
def page_headings(spark, sf):
    return page_ops.header_rows(page_fields(spark, sf, "headers"))


@query("page_anchors", f"""WITH l AS (SELECT url, regexp_extract_all(html, '(?i)<a href="([^"]+)"', 1) AS refs FROM pages),
    x AS (SELECT url, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM l)
    SELECT url AS src, regexp_extract(url, '^https?://[^/?#]+') || {_UNESCAPE.format('ref')} AS dst, pos FROM x""")
def page_anchors(spark, sf):
    return page_ops.anchor_edges(page_fields(spark, sf, "links"))


def rich_pages(spark, sf):
    """One shop page per part, with the tags the stored pages lack."""
    part = table(spark, sf, "part", spread=True)
    name, price, key = F.col("p_name"), F.format_string("%.2f", F.col("p_retailprice")), F.col("p_partkey").cast("string")
    meta = F.concat(
        F.lit('<meta name="description" content="'), name, F.lit('"><meta property="product:price:amount" content="'), price,
        F.lit('"><meta property="product:price:currency" content="USD"><meta content="nameless">'),
    )
    ld = F.concat(
        F.lit('<script type="application/ld+json">{"@type": "Product", "name": "'), name,
        F.lit('", "offers": {"price": "'), price, F.lit('"}}</script><script type="application/ld+json">{broken</script>'),
    )
    img = F.concat(F.lit('<img src="/i/'), key, F.lit('.png" alt="'), name, F.lit('"><img title="x">'))
    html = F.concat(
        F.lit("<html><head><title>Oferta</title>"), meta, ld, F.lit("</head><body><main>Texto <b>principal</b></main>"), img, F.lit("</body></html>")
    )
    return part.select(F.concat(F.lit("https://shop.example.com.uy/producto/"), key).alias("url"), html.alias("html"), "p_partkey", "p_name", "p_retailprice")


@query("rich_page_rows", """SELECT 'https://shop.example.com.uy/producto/' || p_partkey AS url, 'Oferta' AS title, p_name AS description,
    'Textoprincipal' AS main_content, 'OfertaTextoprincipal' AS full_text, 1 AS json_blocks, 200 AS status_code, 'text/html' AS content_type,
    '2024-01-05 10:00:00' AS last_modified FROM part""")
def rich_page_rows(spark, sf):
    headers = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("last-modified"), F.lit("Fri, 05 Jan 2024 10:00:00 GMT")
    )
    raw = rich_pages(spark, sf).select(
        "url", "html", F.lit(200).alias("status_code"), headers.alias("response_headers"), F.lit("2024-01-06").cast("timestamp").alias("fetched_at")
    )
    return page_ops.page_rows(raw).select(
        "url", "title", "description", "main_content", "full_text", F.size("structured_data").alias("json_blocks"),
        "status_code", "content_type", stamp("last_modified"),
    )


@query("rich_page_images", """SELECT 'https://shop.example.com.uy/producto/' || p_partkey AS url, '/i/' || p_partkey || '.png' AS src, p_name AS alt, '' AS title FROM part
    UNION ALL SELECT 'https://shop.example.com.uy/producto/' || p_partkey, '', '', 'x' FROM part""")
def rich_page_images(spark, sf):
    return page_ops.image_rows(page_ops.extract_fields(rich_pages(spark, sf), fields=["images"]))


@query("rich_page_meta", """SELECT name, count(*) AS pages FROM (SELECT unnest(['description', 'product:price:amount', 'product:price:currency']) AS name FROM part) GROUP BY name""")
def rich_page_meta(spark, sf):
    return page_ops.meta_stats(page_ops.extract_fields(rich_pages(spark, sf), fields=["meta_tags"]))


@query("links_harvest", """WITH l AS (SELECT url, regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1) AS refs FROM pages),
    x AS (SELECT url, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM l)
    SELECT url AS src, regexp_extract(url, '^https?://[^/?#]+') || ref AS dst, pos FROM x""")
def links_harvest(spark, sf):
    return page_ops.harvested_edges(table(spark, sf, "pages"))


# -- decisions -------------------------------------------------------------------------------
_NOW = "2024-01-20 00:00:00"
_KIND = "['search', 'geo', 'page_type', 'relevance', 'price'][1 + user_id % 5]"
_TTL = "[3600, 604800, 21600, 21600, 7200][1 + user_id % 5]"


def decisions(spark, sf):
    """Events as decisions: user is the key, the event type is the value."""
    kinds = F.array(*[F.lit(k) for k in ("search", "geo", "page_type", "relevance", "price")])
    return table(spark, sf, "events").select(
        F.element_at(kinds, (F.col("user_id") % 5 + 1).cast("int")).alias("kind"),
        store.decision_key(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        F.col("event_type").alias("value"),
        F.col("ts").alias("decided_at"),
    )


@query("ttl_lookup", f"""WITH d AS (SELECT {_KIND} AS kind, sha256('u|' || user_id) AS key, event_type AS value, ts FROM events
      WHERE ts <= TIMESTAMP '{_NOW}' AND ts > TIMESTAMP '{_NOW}' - to_seconds({_TTL})),
    a AS (SELECT kind, key, max_by(value, ts) AS value, max(ts) AS ts FROM d GROUP BY ALL),
    r AS (SELECT DISTINCT {_KIND} AS kind, sha256('u|' || user_id) AS key FROM events)
    SELECT kind, key, value, {sql_stamp('ts')} AS decided_at, ts IS NOT NULL AS hit FROM r LEFT JOIN a USING (kind, key)""")
def ttl_lookup(spark, sf):
    known = decisions(spark, sf)
    asked = known.select("kind", "key").distinct()
    found = store.reuse_decisions(asked, known, F.lit(_NOW).cast("timestamp"))
    return found.select("kind", "key", "value", stamp("decided_at"), "hit")


@query("ttl_write_back", f"""WITH d AS (SELECT {_KIND} AS kind, sha256('u|' || user_id) AS key, event_type AS value, ts FROM events
      WHERE ts < TIMESTAMP '{_NOW}' OR event_type <> 'error')
    SELECT kind, key, max_by(value, ts) AS value, {sql_stamp('max(ts)')} AS decided_at FROM d GROUP BY ALL""")
def ttl_write_back(spark, sf):
    rows, now = decisions(spark, sf), F.lit(_NOW).cast("timestamp")
    fresh = rows.filter(F.col("decided_at") >= now).withColumn(
        "value", F.when(F.col("value") == "error", "ERROR_FAILED").otherwise(F.col("value"))
    )
    merged = store.record_decisions(rows.filter(F.col("decided_at") < now), fresh)
    return merged.select("kind", "key", "value", stamp("decided_at"))


def tier_tables(spark, sf):
    docs = document_pages(spark, sf)
    shaped = lambda df, when: df.select(
        "url", F.lit("").alias("text"), "full_text", "main_content", when.alias("saved_at")
    )
    doc_id = F.regexp_extract("url", r"(\d+)$", 1).cast("bigint")
    now = F.lit(_NOW).cast("timestamp")
    ago = lambda seconds: F.timestamp_seconds(F.unix_seconds(now) - seconds)
    labelled = docs.join(requested_urls(spark, sf), "url", "left_semi")
    memory = shaped(labelled, ago(doc_id % 600))
    cache = shaped(docs.filter(F.col("description") == "fr"), ago(doc_id * 7))
    stored = shaped(docs.filter(F.col("description") != "de"), ago(F.lit(999999)))
    return memory, cache, stored, now


_TIERS = f"""WITH {_REQUESTED}, t AS (
      SELECT url, 1 AS rank, 'memory' AS tier, text FROM docs WHERE url IN (SELECT url FROM req) AND doc_id % 600 < 300
      UNION ALL SELECT url, 2, 'cache', text FROM docs WHERE lang = 'fr' AND doc_id * 7 < 3600
      UNION ALL SELECT url, 3, 'stored', text FROM docs WHERE lang <> 'de'),
    b AS (SELECT url, min(rank) AS rank, min_by(tier, rank) AS tier, min_by(text, rank) AS text FROM t GROUP BY url),
    found AS (SELECT url, coalesce(tier, 'miss') AS tier, md5(text) AS content FROM req LEFT JOIN b USING (url))"""


@query("tiered_lookup", f"{_TIERS} SELECT * FROM found")
def tiered_lookup(spark, sf):
    memory, cache, stored, now = tier_tables(spark, sf)
    return store.tiered_lookup(requested_urls(spark, sf), memory, cache, stored, now).select(
        "url", "tier", F.md5("text").alias("content")
    )


@query("tier_stats", f"""{_TIERS} SELECT count(*) AS requests, count(*) FILTER (tier = 'memory') AS memory_hits, count(*) FILTER (tier = 'cache') AS cache_hits,
    count(*) FILTER (tier = 'stored') AS stored_hits, count(*) FILTER (tier = 'miss') AS misses,
    round((count(*) - count(*) FILTER (tier = 'miss')) / count(*) * 100, 2) AS hit_rate FROM found""")
def tier_stats(spark, sf):
    memory, cache, stored, now = tier_tables(spark, sf)
    return store.tier_stats(store.tiered_lookup(requested_urls(spark, sf), memory, cache, stored, now))


@query("tier_promotions", f"{_TIERS} SELECT url, content FROM found WHERE tier IN ('cache', 'stored')")
def tier_promotions(spark, sf):
    memory, cache, stored, now = tier_tables(spark, sf)
    moved = store.promotions(store.tiered_lookup(requested_urls(spark, sf), memory, cache, stored, now))
    return moved.select("url", F.md5("text").alias("content"))


@query("recent_pages", f"SELECT 'https://site.example.com/e/' || event_id AS url, {sql_stamp('ts')} AS crawled_at FROM events ORDER BY ts DESC, 1 LIMIT 25")
def recent_pages(spark, sf):
    return store.recent_pages(stored_pages(spark, sf), 25).select("url", stamp("crawled_at"))


@query("pages_by_domain", "SELECT page_id, url FROM pages WHERE contains(url, 'example.org')")
def pages_by_domain(spark, sf):
    return store.pages_by_domain(table(spark, sf, "pages"), "example.org").select("page_id", "url")
