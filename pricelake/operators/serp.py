"""Search-result intake: fan-out, page parse, text fallback, engine breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.functions import html as html_helper
from pricelake.functions import rules, text, urls
from pricelake.functions.expr import let
from pricelake.operators.urltable import keep_first

_HITS = "array<struct<stage: int, title: string, url: string, description: string>>"


def search_urls(queries: DataFrame, google: bool = False) -> DataFrame:
    """One row per query and engine; the engine list is an array literal, not a join."""
    table = rules.ENGINE_TEMPLATES + ([rules.GOOGLE_TEMPLATE] if google else [])
    engines = F.array(
        *[F.struct(F.lit(e).alias("engine"), F.lit(a).alias("head"), F.lit(b).alias("tail")) for e, a, b in table]
    )
    asked = F.url_encode(F.concat_ws(" ", "query", "country"))
    return queries.select("query_id", asked.alias("q"), F.posexplode(engines).alias("pos", "e")).select(
        "query_id", F.col("e.engine").alias("engine"), "pos", F.concat("e.head", "q", "e.tail").alias("search_url")
    )


def engine_of(domain: Column) -> Column:
    low = F.lower(F.coalesce(domain, F.lit("")))
    chain = F.when(low.contains("duckduckgo"), "duckduckgo")
    for name in ("startpage", "ecosia", "qwant", "google"):
        chain = chain.when(low.contains(name), name)
    return chain.when(low != "", low).otherwise("unknown")


def parse_result_pages(serp_pages: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Result pages (query_id, engine, html) to hits, whatever the engine; the first ``max_hits`` of each page.

    One Arrow pass finds the result blocks; cleaning and stage choice stay in the row as Column expressions, so
    nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [html_helper.result_hits(e, h) for e, h in zip(batch["engine"], batch["html"])]
            yield pd.DataFrame(
                {
                    "query_id": batch["query_id"],
                    "engine": batch["engine"],
                    "hits": [f["hits"] for f in found],
                    "text": [f["text"] for f in found],
                }
            )

    kind = serp_pages.schema["query_id"].dataType.simpleString()
    parsed = serp_pages.select("query_id", "engine", "html").mapInPandas(
        run, f"query_id {kind}, engine string, hits {_HITS}, text string"
    )
    clean = F.filter(
        F.transform("hits", lambda h: h.withField("url", urls.sanitize(h["url"]))), lambda h: h["url"].isNotNull()
    )
    found = parsed.withColumn("found", let(clean, _best_stage))
    hits = F.when(F.size("found") > 0, F.col("found")).when(F.col("text").isNotNull(), _text_hits(F.col("text")))
    hits = _first(hits, max_hits)
    return _hit_rows(found, hits, ["query_id", "engine"])


def _best_stage(hits: Column) -> Column:
    """Hits of the first stage that yields anything."""
    first = F.array_min(F.transform(hits, lambda h: h["stage"]))
    plain = lambda h: F.struct(h["title"].alias("title"), h["url"].alias("url"), h["description"].alias("description"))
    return F.transform(F.filter(hits, lambda h: h["stage"] == first), plain)


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _hit_rows(pages: DataFrame, hits: Column, carried: list[str]) -> DataFrame:
    # outer, so that no filter on the hits is inferred below and evaluates them twice
    return (
        pages.select(*carried, F.posexplode_outer(hits).alias("pos", "h"))
        .filter(F.col("h").isNotNull())
        .select(*carried, "pos", "h.title", "h.url", "h.description")
    )


# ---- fixed values: title/URL patterns of the text fallback ---------------------------------
_TEXT_PATTERNS = [
    (r"(?im)([A-Za-z][^\n]*?[a-zA-Z])\s*\n?\s*(https?://[^\s]+(?:\.com\.uy|\.uy|\.com)[^\s]*)"),
    (r"(?im)(https?://[^\s]+(?:\.com\.uy|\.uy|\.com)[^\s]*)[^\n]*?([A-Za-z][^\n]*?[a-zA-Z])"),
    (r"(?im)([a-zA-Z][^\n]*?(?:\.com\.uy|\.uy|\.com)[^\n]*?)\s*(https?://[^\s]+)"),
]
_BARE_URL = r"(https?://[^\s]+(?:\.com\.uy|\.uy|\.com|\.org)[^\s]*)"
_SKIP_TITLES = ["next", "previous", "page", "anonymous view", "visit in anonymous"]
_BANNERS = ["Web results", "Results"]
_TEXT_TRACKING = ["srsltid=", "utm_"]
_LIST_MARKS = "•-*| \t\n\r\f\u00a0"


def _drop_tracking(url: Column) -> Column:
    return F.regexp_replace(url, "[&?](?:" + "|".join(_TEXT_TRACKING) + ")[^&]*", "")


def _clean_title(title: Column) -> Column:
    """Drop what stands before the end of a results banner, then list marks and blanks at both ends."""
    return F.btrim(F.regexp_replace(title, "(?i)^.*?(?:" + "|".join(_BANNERS) + ")", ""), F.lit(_LIST_MARKS))


def _literal(text: Column) -> Column:
    """Text as a pattern that matches just it."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _description(body: Column, title: Column, url: Column, around: int, longest: int) -> Column:
    """Up to ``longest`` characters right behind the URL or title, looked for ``around`` so many characters from the URL; null
    where there are none."""
    at = F.instr(body, url)
    start = F.greatest(at - around, F.lit(1))
    near = F.substring(body, start, at - start + F.length(url) + around)
    pattern = F.concat(F.lit("(?is)(?:"), _literal(url), F.lit("|"), _literal(title), F.lit(")\\s*([A-Za-z][^\n]{10,%d})" % longest))
    return F.when(at > 1, text.blank_to_null(F.trim(F.call_function("regexp_extract", near, pattern, F.lit(1)))))


def _first_per_url(hits: Column) -> Column:
    """Array version of keep-first by URL."""
    seen = F.transform(hits, lambda h: h["url"])
    return F.filter(hits, lambda h, i: F.array_position(seen, h["url"]) == i + 1)


def text_hits(pages: DataFrame, column: str, max_hits: int | None = None, around: int = 200, longest: int = 100) -> DataFrame:
    """Title and URL pairs from plain text, else bare URLs titled by domain; the first ``max_hits`` of each text. A description
    has up to ``longest`` characters and is looked for ``around`` so many characters from its URL."""
    carried = [c for c in ("query_id", "engine") if c in pages.columns]
    return _hit_rows(pages, _first(_text_hits(F.col(column), around, longest), max_hits), carried)


def _text_hits(text: Column, around: int = 200, longest: int = 100) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda l: ~l.rlike(r"(?U)^\s*$"))
    return let(let(lines, _near_urls), lambda body: let(_titled_hits(body, around, longest), lambda t: F.when(F.size(t) > 0, t).otherwise(_bare_hits(body))))


def _near_urls(lines: Column) -> Column:
    """Lines with a URL or right before one. The others cannot match, and would cost time squared in
    their length.
    """
    before = lambda i: F.coalesce(F.get(lines, i + 1).rlike(r"(?U)^\s*https?://"), F.lit(False))
    return F.array_join(F.filter(lines, lambda l, i: l.contains("http") | before(i)), "\n")


def _titled_hits(body: Column, around: int, longest: int) -> Column:
    pairs = []
    for pattern in _TEXT_PATTERNS:
        zipped = F.zip_with(
            F.regexp_extract_all(body, F.lit(pattern), 1),
            F.regexp_extract_all(body, F.lit(pattern), 2),
            lambda a, b: F.when(b.contains("http"), F.struct(a.alias("title"), b.alias("url"))).otherwise(
                F.struct(b.alias("title"), a.alias("url"))
            ),
        )
        pairs.append(zipped)
    named = F.filter(F.concat(*pairs), lambda h: h["url"].startswith("http"))
    cleaned = F.transform(
        named,
        lambda h: F.struct(
            _clean_title(h["title"]).alias("title"), urls.sanitize(_drop_tracking(h["url"])).alias("url")
        ),
    )
    kept = F.filter(
        cleaned,
        lambda h: h["url"].isNotNull() & (F.length(h["title"]) >= 3) & ~F.lower(h["title"]).rlike("|".join(_SKIP_TITLES)),
    )
    shaped = lambda h: F.struct(h["title"].alias("title"), h["url"].alias("url"), _description(body, h["title"], h["url"], around, longest).alias("description"))
    return let(kept, lambda k: F.transform(_first_per_url(k), shaped))


def _bare_hits(body: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(_BARE_URL), 1))
    clean = F.filter(F.transform(found, lambda u: urls.sanitize(_drop_tracking(u))), lambda u: u.isNotNull())
    domain = lambda u: F.replace(urls.netloc(u), F.lit("www."), F.lit(""))
    return F.transform(
        F.array_distinct(clean),
        lambda u: F.struct(
            F.initcap(F.substring_index(domain(u), ".", 1)).alias("title"),
            u.alias("url"),
            F.concat(F.lit("Product search result from "), domain(u)).alias("description"),
        ),
    )


def flag_blocked(pages: DataFrame, html: str = "html", min_chars: int = 0) -> DataFrame:
    """Add ``blocked`` and ``reason``; pages shorter than ``min_chars`` count as blocked."""
    mark = text.blocked_html(F.col(html), min_chars)
    return pages.withColumn("blocked", mark["blocked"]).withColumn("reason", mark["reason"])


def result_budget(hits: DataFrame, budget: int) -> DataFrame:
    """First hit per query and URL, then the first ``budget`` per query.

    The second step is a top-n per key: tasks cut before the shuffle, so a busy query stays small.
    """
    first = keep_first(hits.filter(F.col("url").isNotNull() & (F.col("url") != "")), ["query_id", "url"])
    order = Window.partitionBy("query_id").orderBy("pos", "url")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= budget)


# -- engine breaker --------------------------------------------------------------------------
def breaker_event(min_chars: int = 0) -> Column:
    """open / close / none for a fetch log row (outcome, html_len, hits, blocked); shorter pages open it."""
    empty = (F.col("outcome") != "ok") | (F.coalesce("html_len", F.lit(0)) == 0)
    tiny = F.col("html_len") < min_chars
    return (
        F.when(empty | tiny, "open")
        .when((F.col("hits") == 0) & F.col("blocked"), "open")
        .when(F.col("hits") > 0, "close")
        .otherwise("none")
    )


def breaker_state(fetch_log: DataFrame, as_of: Column, ttl_seconds: int = 1800, min_chars: int = 0) -> DataFrame:
    """Engine state at ``as_of``: the latest deciding event, while it is younger than the TTL."""
    decided = (
        fetch_log.withColumn("event", breaker_event(min_chars))
        .filter((F.col("event") != "none") & (F.col("ts") <= as_of))
        .groupBy("engine")
        .agg(F.max_by("event", F.struct("ts", "event")).alias("event"), F.max("ts").alias("since"))
    )
    fresh = F.unix_micros(as_of) - F.unix_micros("since") < ttl_seconds * 1000000
    return decided.withColumn("is_open", (F.col("event") == "open") & fresh)


def enabled_engines(asked: DataFrame, state: DataFrame) -> DataFrame:
    """Searches to run: closed engines; one probe when at most one engine is left.

    ``asked`` has one row per (query_id, engine). At most five engines per query, so the rank is small.
    """
    open_now = state.filter("is_open").select("engine", F.lit(True).alias("is_open"))
    rows = asked.join(open_now, "engine", "left").withColumn("is_open", F.coalesce("is_open", F.lit(False)))
    counts = rows.groupBy("query_id").agg(
        F.count_if(~F.col("is_open")).alias("closed"),
        F.collect_set(F.when(F.col("is_open"), F.col("engine"))).alias("open_engines"),
    )

    def first_of(order: list[str]) -> Column:
        wanted = F.array(*[F.lit(e) for e in order])
        return F.try_element_at(F.filter(wanted, lambda e: F.array_contains("open_engines", e)), F.lit(1))

    probe = F.when(F.col("closed") == 0, first_of(rules.PROBE_ORDER_ALL_OPEN)).when(
        F.col("closed") == 1, first_of(rules.PROBE_ORDER_ONE_LEFT)
    )
    chosen = rows.join(counts.withColumn("probe", probe).select("query_id", "probe"), "query_id")
    is_probe = F.coalesce(F.col("is_open") & (F.col("engine") == F.col("probe")), F.lit(False))
    return chosen.withColumn("is_probe", is_probe).filter(~F.col("is_open") | F.col("is_probe")).drop("probe", "is_open")
