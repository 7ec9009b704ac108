"""Page typing and category expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.functions import geo, rules, urls
from pricelake.functions.expr import let
from pricelake.operators.ordered import ranked
from pricelake.operators.store import decision_key, reuse_decisions
from pricelake.operators.urltable import keep_first


def page_type(candidates: DataFrame, country: str | None = None) -> DataFrame:
    """Rule-decided type with its source.

    ``country`` names the request country column; without it the home country is assumed. Rows no rule
    decides keep a rule-based guess flagged ``heuristic``, or stay ``UNRESOLVED``.
    """
    url = F.col("url")
    if country is None:
        local = geo.is_home_url(url)
    else:
        local = F.when(F.col(country) == "UY", geo.is_home_url(url)).otherwise(
            geo.is_country_host(url, F.col(country)) | geo.has_country_path(url, F.col(country))
        )
    guess = urls.is_product_url(url) | urls.is_single_product(url)
    return candidates.withColumn(
        "page_type",
        F.when(~local, "EXCLUDE_NON_URUGUAY")
        .when(urls.is_marketplace_listing(url), "CATEGORY")
        .when(urls.is_marketplace_product(url), "PRODUCT")
        .when(guess, "PRODUCT")
        .otherwise("UNRESOLVED"),
    ).withColumn(
        "type_source",
        F.when(~local | urls.is_marketplace_listing(url) | urls.is_marketplace_product(url), "rule")
        .when(guess, "heuristic")
        .otherwise("none"),
    )


def stored_types(candidates: DataFrame, decisions: DataFrame, as_of: Column, pinned: bool = False) -> DataFrame:
    """Types that no rule is sure of, taken from live stored decisions (kind ``page_type``, key of URL and query) where there are any.

    ``candidates`` have been through ``page_type`` and have a ``query``; the source of a type that is taken is ``stored``.
    ``pinned`` as in ``reuse_decisions``.
    """
    keyed = candidates.withColumn("kind", F.lit("page_type")).withColumn("key", decision_key("url", "query"))
    taken = F.col("hit") & (F.col("type_source") != "rule")
    settled = reuse_decisions(keyed, decisions, as_of, pinned).withColumns(
        {"page_type": F.when(taken, F.col("value")).otherwise(F.col("page_type")), "type_source": F.when(taken, "stored").otherwise(F.col("type_source"))}
    )
    return settled.select(*candidates.columns)


def drop_errors(candidates: DataFrame) -> DataFrame:
    return candidates.filter(~F.coalesce(F.col("page_type").startswith("ERROR_"), F.lit(False)))


def error_counts(candidates: DataFrame) -> DataFrame:
    bad = F.coalesce(F.col("page_type").startswith("ERROR_"), F.lit(False))
    return candidates.agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("dropped"))


def _country(table: DataFrame) -> list[str]:
    return [c for c in ("country",) if c in table.columns]


def expandable_links(categories: DataFrame, edges: DataFrame) -> DataFrame:
    """Product links of category pages before the caps.

    ``categories(query_id, url, pos, terms)`` and, where it is there, ``country``; ``edges(src, dst, pos)``. Row filters come before both
    dedupes where they cannot change the result.
    """
    # everything about the category page is settled before the join
    pages = categories.select(
        "query_id", F.col("url").alias("src"), F.col("pos").alias("src_pos"), "terms", *_country(categories),
        urls.netloc(F.col("url")).alias("src_host"), urls.is_marketplace_listing(F.col("url")).alias("listing"),
    ).withColumn("market", F.col("src_host").contains(rules.MARKETPLACE_DOMAIN))
    here = lambda n: F.when(F.col("market"), F.lower(n).isin(rules.MARKETPLACE_LINK_HOSTS)).otherwise(
        (n != "") & (n == F.col("src_host"))
    )

    def wanted(link: Column) -> Column:
        product = F.when(F.col("listing"), urls.is_marketplace_product(link)).otherwise(
            urls.is_product_url(link, F.col("terms"))
        )
        keep = product & urls.matches_query(link, F.col("terms"))
        return F.when(keep, F.array(link)).otherwise(F.array().cast("array<string>"))

    local = pages.join(edges, "src").filter(let(urls.netloc(F.col("dst")), here))
    # exploding none or one link filters and computes it in one go
    kept = local.select(
        "query_id", "src_host", "src", "src_pos", "pos", *_country(categories),
        F.explode(let(urls.drop_repeated_segments(F.col("dst")), wanted)).alias("link"),
    )
    return keep_first(kept, ["query_id", "src", "link"], "pos")


def expand_categories(
    categories: DataFrame, edges: DataFrame, per_host: int | None = None, per_query: int | None = None
) -> DataFrame:
    """Product links of category pages; at most ``per_host`` per category host and ``per_query`` per search, in
    order, where these are given."""
    order = ["src_pos", "pos", "link"]
    links = expandable_links(categories, edges)
    host = Window.partitionBy("query_id", "src_host").orderBy(*order)
    query = Window.partitionBy("query_id").orderBy(*order)
    for limit, window in ((per_host, host), (per_query, query)):
        if limit is not None:
            links = links.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= limit).drop("__n")
    first = keep_first(links, ["query_id", "link"], F.struct(*order))
    return first.select("query_id", F.col("link").alias("url"), "src", "src_host", "src_pos", "pos", *_country(categories))


def low_yield(categories: DataFrame, expanded: DataFrame) -> DataFrame:
    """Searches whose expansion found too little and the fallback each one needs."""
    asked = categories.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("categories"), F.max(F.size("terms")).alias("terms")
    )
    found = expanded.groupBy("query_id").agg(F.count(F.lit(1)).alias("links"))
    return (
        asked.join(found, "query_id", "left")
        .withColumn("links", F.coalesce("links", F.lit(0)))
        .select(
            "query_id", "categories", "links",
            ((F.col("links") < 5) & (F.col("categories") <= 3)).alias("per_page_retry"),
            ((F.col("links") < 3) & (F.col("terms") > 0)).alias("needs_labels"),
        )
    )


def fallback_links(categories: DataFrame, edges: DataFrame, low: DataFrame) -> DataFrame:
    """Same-host links of low-yield searches after a cheap filter, for outside labelling."""
    wanted = categories.join(low.filter("needs_labels").select("query_id"), "query_id", "left_semi")
    links = (
        wanted.select("query_id", F.col("url").alias("src"), F.col("pos").alias("src_pos"))
        .join(edges, "src")
        .filter(urls.same_domain(F.col("src"), F.col("dst")))
        .filter(~urls.contains_any(F.lower("dst"), ["/search", "/category", "?page=", "#"]))
    )
    return keep_first(
        links.select("query_id", F.col("dst").alias("url"), "src_pos", "pos"), ["query_id", "url"], F.struct("src_pos", "pos")
    )


def merge_expanded(candidates: DataFrame, expanded: DataFrame, cap: int | None = None) -> DataFrame:
    """Add typed PRODUCT links from expansion that are not candidates yet, after the existing ones.

    Known links are left out first, so they use up no places; ``cap`` then limits the new links per search. New links are
    ranked behind the last position of their search. A ``country`` column of ``expanded`` decides what is local; a
    ``stored_type`` is used where no rule is sure.
    """
    order = ["src_pos", "pos", "url"]
    fresh = expanded.join(candidates.select("query_id", "url"), ["query_id", "url"], "left_anti")
    if cap is not None:
        window = Window.partitionBy("query_id").orderBy(*order)
        fresh = fresh.withColumn("__r", F.row_number().over(window)).filter(F.col("__r") <= cap).drop("__r")
    country = _country(expanded)
    typed = page_type(fresh, *country)
    if "stored_type" in expanded.columns:
        unsure = F.col("type_source") != "rule"
        typed = typed.withColumn("page_type", F.when(unsure, F.coalesce("stored_type", "page_type")).otherwise(F.col("page_type")))
    typed = typed.filter(F.col("page_type") == "PRODUCT")
    last = candidates.groupBy("query_id").agg(F.max("pos").alias("__last"))
    placed = ranked(typed.select("query_id", *order), ["query_id"], order, "__rank").join(last, "query_id", "left")
    added = placed.select(
        "query_id",
        "url",
        F.lit("Expanded from category").alias("original_title"),
        F.lit("").alias("original_snippet"),
        F.lit("PRODUCT").alias("page_type"),
        (F.coalesce("__last", F.lit(-1)) + F.col("__rank")).cast("long").alias("pos"),
    )
    return candidates.select(*added.columns).unionByName(added)
