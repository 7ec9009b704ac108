"""Page field extraction: raw HTML rows to stored page rows, headings, links, payload summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import html as html_helper
from pricelake.functions import urls

_FIELDS = {
    "title": "string", "full_text": "string", "main_content": "string", "headers": "map<string, array<string>>",
    "meta_tags": "map<string, string>", "images": "array<struct<src: string, alt: string, title: string>>",
    "json_ld": "array<string>", "links": "array<string>",
}


def extract_fields(pages: DataFrame, keep: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """One pass over ``html`` giving the page fields named, all by default. ``keep`` names columns carried along."""
    carried = ["url"] + [c for c in (keep or []) if c != "url"]
    wanted = list(fields or _FIELDS)
    schema = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carried] + [f"{c} {_FIELDS[c]}" for c in wanted]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [html_helper.page_fields(u, h, wanted) for u, h in zip(batch["url"], batch["html"])]
            out = pd.DataFrame(found, columns=wanted)
            for c in carried:
                out[c] = batch[c].to_numpy()
            yield out[[*carried, *wanted]]

    source = pages.select(*carried, *([] if "html" in carried else ["html"]))
    return source.mapInPandas(run, ", ".join(schema))


def page_rows(raw: DataFrame) -> DataFrame:
    """Raw crawl rows (url, html, status_code, headers map, fetched_at) to stored page rows."""
    response = ["status_code", "response_headers", "fetched_at"]
    fields = extract_fields(raw, keep=["html", *response])
    return build_rows(fields)


def parse_http_time(text: Column) -> Column:
    """ISO or HTTP date; anything else is null."""
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z")),
    )


def build_rows(fields: DataFrame) -> DataFrame:
    """Stored row from extracted fields and response headers."""
    head = lambda name: F.try_element_at("response_headers", F.lit(name))
    return fields.select(
        "url", "status_code", head("content-type").alias("content_type"), "html", "title",
        F.try_element_at("meta_tags", F.lit("description")).alias("description"),
        "main_content", "full_text", "headers", "meta_tags",
        F.filter("json_ld", lambda s: F.try_parse_json(s).isNotNull()).alias("structured_data"),
        "links", "images", head("content-language").alias("content_language"),
        parse_http_time(head("last-modified")).alias("last_modified"),
        F.col("fetched_at").alias("crawled_at"),
        F.lit(None).cast("timestamp").alias("last_updated"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


def header_rows(fields: DataFrame) -> DataFrame:
    return fields.select("url", F.explode("headers").alias("level", "texts")).select(
        "url", "level", F.posexplode("texts").alias("pos", "text")
    )


def meta_rows(fields: DataFrame) -> DataFrame:
    return fields.select("url", F.explode("meta_tags").alias("name", "content"))


def meta_stats(fields: DataFrame) -> DataFrame:
    """How many pages carry each meta tag."""
    return meta_rows(fields).groupBy("name").agg(F.count(F.lit(1)).alias("pages"))


def image_rows(fields: DataFrame) -> DataFrame:
    return fields.select("url", F.inline("images"))


def anchor_edges(fields: DataFrame) -> DataFrame:
    """Link graph from anchors: (src, dst, pos)."""
    return fields.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "dst")).select("src", "dst", "pos")


def harvested_edges(pages: DataFrame) -> DataFrame:
    """Link graph from the raw HTML by pattern, without a Python worker."""
    found = pages.select(F.col("url").alias("src"), F.posexplode(urls.link_matches(F.col("html"))).alias("pos", "ref"))
    absolute = F.when(F.col("ref").startswith("http"), F.col("ref")).otherwise(urls.resolve(F.col("src"), F.col("ref")))
    return found.select("src", absolute.alias("dst"), "pos")


def slim_payload(results: DataFrame) -> DataFrame:
    """Summary for consumers: lengths instead of bodies, image head of 120 characters, first five links."""
    return results.select(
        "url",
        F.length(F.coalesce("html", F.lit(""))).alias("html_len"),
        F.length(F.coalesce("screenshot", F.lit(""))).alias("screenshot_len"),
        F.substring("screenshot", 1, 120).alias("screenshot_head"),
        F.size("results").alias("total"),
        F.slice("results", 1, 5).alias("first_results"),
    )
