"""Candidate filters between result intake and page typing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.functions import rules, urls
from pricelake.functions.expr import let
from pricelake.operators.urltable import keep_first
from pricelake.session import BROADCAST_BYTES, cut_lineage, measured_bytes


def flatten_results(results: DataFrame) -> DataFrame:
    """Nested search responses (query, pos, results.web.results[]) to first-seen clean candidates."""
    hits = results.select(
        "query_id", F.col("query").alias("source_query"), F.col("pos").alias("query_pos"),
        F.posexplode("results.web.results").alias("hit_pos", "hit"),
    ).select(
        "query_id", "source_query", "query_pos", "hit_pos",
        urls.sanitize(F.col("hit.url")).alias("url"),
        F.col("hit.title").alias("original_title"),
        F.col("hit.description").alias("original_snippet"),
    )
    return keep_first(hits.filter(F.col("url").isNotNull()), ["query_id", "url"], F.struct("query_pos", "hit_pos"))


def is_blocked_domain(url: Column, domains: list[str] | None = None) -> Column:
    """Host equals a listed domain or is a subdomain of one.

    The end of the host is looked up in one set per number of labels.
    """
    by_labels: dict[int, list[str]] = {}
    for domain in domains or rules.BLOCKED_DOMAINS:
        by_labels.setdefault(domain.count(".") + 1, []).append(domain)
    host = F.lower(urls.netloc(url))
    return reduce(lambda a, b: a | b, [F.substring_index(host, ".", -n).isin(listed) for n, listed in sorted(by_labels.items())])


def is_excluded(url: Column) -> Column:
    """A listed path segment, listing page or file extension: one pattern each, which starts at its own character."""
    patterns = [
        "/(?:" + _by_first(rules.EXCLUDE_SEGMENTS) + ")/",
        r"\.(?:" + _by_first(rules.EXCLUDE_EXTENSIONS) + ")$",
        rules.EXCLUDE_LISTING_PATTERN,
    ]
    return let(F.lower(url), lambda low: urls.any_of([low.rlike(p) for p in patterns]))


def _by_first(words: list[str]) -> str:
    """Alternatives by first character, so that most are not tried."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


def is_high_priority(url: Column) -> Column:
    return F.lower(url).rlike("(?i)" + "|".join(rules.PRIORITY_PATTERNS))


def tag_filters(candidates: DataFrame, url: str = "url") -> DataFrame:
    """Cheap set test first, one alternation second; rows are tagged, not dropped."""
    u = F.col(url)
    return (
        candidates.withColumn("blocked_domain", is_blocked_domain(u))
        .withColumn("excluded", is_excluded(u))
        .withColumn("high_priority", is_high_priority(u))
    )


def pattern_filter(candidates: DataFrame, url: str = "url") -> DataFrame:
    return candidates.filter(~is_blocked_domain(F.col(url))).filter(~is_excluded(F.col(url)))


def host_cap(candidates: DataFrame, cap: int | None = None, url: str = "url", pos: str = "pos") -> DataFrame:
    """First row per (query, normalized URL), then at most ``cap`` per (query, host) in order; ``None`` keeps all.

    Both steps cut inside each task before their shuffle: the first is an aggregation, the second a
    top-n per key, so a host that holds a third of all rows sends ``tasks * cap`` rows at most.
    """
    # the key is scheme://host/path with the canonical host as its third part
    keyed = candidates.withColumn("dedupe_key", urls.normalize(F.col(url), drop_query=True)).withColumn(
        "host", F.split_part("dedupe_key", F.lit("/"), F.lit(3))
    )
    first = keep_first(keyed, ["query_id", "host", "dedupe_key"], F.struct(pos, url))
    if cap is None:
        return first
    order = Window.partitionBy("query_id", "host").orderBy(pos, url)
    return first.withColumn("host_rank", F.row_number().over(order)).filter(F.col("host_rank") <= cap)


def within_reach(candidates: DataFrame, cap: int, url: str = "url", pos: str = "pos") -> DataFrame:
    """Candidates without most of those that ``clean_rows``, ``pattern_filter`` and ``host_cap`` with ``cap`` drop from searches with far
    more rows per host; the result of these steps stays the same.

    A cheap pass keeps the least position per (search, authority, bucket of URLs), and only rows up to the first few buckets are cleaned and
    filtered. Rows of two buckets of dedupe keys have two keys, so the ``cap``-th least position over the buckets of a host bounds
    what the cap can keep. Rows behind it are dropped before their other columns are built, sorted or shuffled; but a
    row whose host is not plain from its URL, or has no bound, stays. Where hosts are too many to broadcast, all rows stay.
    """
    at = F.substring_index(F.col(url), "/", 3)
    nth = lambda n: F.try_element_at(F.array_sort(F.collect_list("__low")), F.lit(n)).alias("__bound")

    def lows(rows: DataFrame, key: Column, host: Column) -> DataFrame:
        bucket = F.pmod(F.xxhash64(key), F.lit(16 * cap)).alias("__bucket")
        return rows.groupBy(F.col("query_id").alias("__q"), host.alias("__host"), bucket).agg(F.min(pos).alias("__low"))

    ahead = cut_lineage(lows(candidates, F.col(url), at).groupBy("__q", "__host").agg(nth(4 * cap)))
    if measured_bytes(ahead) > BROADCAST_BYTES:
        return candidates
    same = F.col("query_id").eqNullSafe(F.col("__q"))
    early = F.col("__bound").isNull() | (F.col(pos) <= F.col("__bound"))
    tried = candidates.join(F.broadcast(ahead), same & (at == F.col("__host")) & early, "left_semi").select("query_id", F.col(url).alias("url"), pos)
    keyed = pattern_filter(urls.clean_rows(tried)).withColumn("__key", urls.normalize(F.col("url"), drop_query=True))
    found = lows(keyed, F.col("__key"), F.split_part("__key", F.lit("/"), F.lit(3)))
    bounds = cut_lineage(found.groupBy("__q", "__host").agg(nth(cap)).filter("__bound IS NOT NULL"))
    if measured_bytes(bounds) > BROADCAST_BYTES:
        return candidates
    # as a predicate it moves below the steps that build the other columns; a join does not
    mine = F.col("query_id").outer().eqNullSafe(F.col("__q")) & (F.col("__host") == F.col("__at").outer())
    behind = F.broadcast(bounds).filter(mine & (F.col("__bound") < F.col(pos).outer())).exists()
    return candidates.withColumn("__at", urls.sound_host(F.col(url))).filter(~behind).drop("__at")


def filter_funnel(candidates: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows kept after each stage and total reduction in percent."""
    tagged = tag_filters(candidates)
    early = tagged.agg(
        F.count(F.lit(1)).alias("initial"),
        F.count_if(~F.col("blocked_domain")).alias("after_blocklist"),
        F.count_if(~F.col("blocked_domain") & ~F.col("excluded")).alias("after_patterns"),
        F.lit(0).cast("bigint").alias("final"),
    )
    zero = F.lit(0).cast("bigint")
    late = host_cap(pattern_filter(candidates), cap).agg(
        zero.alias("initial"), zero.alias("after_blocklist"), zero.alias("after_patterns"), F.count(F.lit(1)).alias("final")
    )
    total = early.unionByName(late).agg(*[F.sum(c).alias(c) for c in early.columns])
    cut = F.round((F.col("initial") - F.col("final")) / F.col("initial") * 100, 2)
    return total.withColumn("reduction_pct", F.when(F.col("initial") > 0, cut).otherwise(0.0))


def enhance_queries(queries: DataFrame) -> DataFrame:
    """Add place names to queries that have none; a query with one is kept as it is."""
    low = F.lower("query")
    has = F.lit(False)
    for code, terms in rules.COUNTRY_QUERY_TERMS.items():
        has = has | ((F.col("country") == code) & urls.contains_any(low, terms))
    if "city" in queries.columns:
        has = has | F.coalesce((F.col("city") != "") & F.contains(low, F.lower("city")), F.lit(False))
    options = F.array(*[F.format_string(t, F.col("query")) for t in rules.ENHANCE_TEMPLATES])
    return queries.withColumn("has_place", has).select(
        "query_id", "query", "country", "has_place",
        F.posexplode(F.when(F.col("has_place"), F.array("query")).otherwise(options)).alias("pos", "enhanced"),
    )


def reconcile_responses(submitted: DataFrame, responses: DataFrame) -> DataFrame:
    """One verdict per submitted query; missing or malformed answers become invalid with a reason."""
    answer = responses.groupBy("query").agg(
        F.max_by(F.struct("valid", "reason"), F.struct(F.col("valid").isNotNull(), "valid", "reason")).alias("a")
    )
    joined = submitted.join(answer, "query", "left")
    return joined.select(
        *submitted.columns,
        F.coalesce("a.valid", F.lit(False)).alias("valid"),
        F.when(F.col("a").isNull(), "missing from response")
        .when(F.col("a.valid").isNull(), "malformed response item")
        .otherwise(F.col("a.reason"))
        .alias("reason"),
    )
