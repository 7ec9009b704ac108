"""Whole jobs composed from the operators: many searches in, one result set per search out."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import urls
from pricelake.operators import candidates as cand
from pricelake.operators import geography, offers, pagetypes, pricing, relevance
from pricelake.operators.urltable import keep_first
from pricelake.session import among, cut_lineage


def best_pages(candidates: DataFrame, per_host: int | None = None, top: int | None = None, min_relevance: float = 0.2) -> DataFrame:
    """Most relevant distinct pages per search; at most ``per_host`` from one host and ``top`` in all where given.

    ``candidates(query_id, query, pos, url, original_title, original_snippet)``. Clean, dedupe and cap
    first (both cut inside the tasks), score what is left, then gate.
    """
    capped = cand.host_cap(cand.pattern_filter(urls.clean_rows(candidates)), per_host)
    return relevance.relevance_gate(relevance.score_candidates(capped), min_relevance, top)


def typed_candidates(
    queries: DataFrame, hits: DataFrame, edges: DataFrame, decisions: DataFrame, as_of: Column, mode: str = "label",
    per_host: int | None = None, links_per_host: int | None = None, links_per_query: int | None = None, new_links: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Result hits to (typed product candidates with links of category pages added, what no rule decides).

    Stored decisions settle places and page types that no rule is sure of. A search whose category pages give too few product links falls
    back to all their links that match the query; those a stored decision or a rule types as products come in. The second table
    has the rows to label outside: ``stage`` is ``geography``, ``page_type`` or, for links of the fallback, ``category_link``.
    Links of category pages pass the same place test as hits. All limits are off by default. Of decisions and edges, which may be far more than
    there are candidates, only those that candidates ask for are gathered.
    """
    asked = queries.select("query_id", "query", "country", "city")
    reached = hits if per_host is None else cand.within_reach(hits, per_host)
    capped = cand.host_cap(cand.pattern_filter(urls.clean_rows(reached)), per_host)
    placed = cut_lineage(geography.validate(cut_lineage(capped.join(asked, "query_id")), decisions, as_of, mode, pinned=True))
    # read for products, for categories and for what is open
    typed = pagetypes.stored_types(pagetypes.page_type(placed.filter("geo_status = 'true'"), "country"), decisions, as_of, pinned=True)
    typed = cut_lineage(pagetypes.drop_errors(typed))
    categories = typed.filter(F.col("page_type") == "CATEGORY").select("query_id", "url", "pos", F.split("query", r"\s+").alias("terms"), "country")
    near = cut_lineage(among(edges, "src", categories.select(F.col("url").alias("src"))))
    links = cut_lineage(pagetypes.expand_categories(categories, near, links_per_host, links_per_query).select(*_LINK))
    more = fallback(categories, near, links).select(*_LINK)
    found = links.withColumn("late", F.lit(False)).unionByName(more.withColumn("late", F.lit(True)))
    local = geography.validate(cut_lineage(found.join(asked.drop("country"), "query_id")), decisions, as_of, mode, pinned=True)
    local = cut_lineage(pagetypes.stored_types(pagetypes.page_type(local, "country"), decisions, as_of, pinned=True))
    stored = F.when(F.col("type_source") == "stored", F.col("page_type"))
    grown = pagetypes.merge_expanded(
        typed.filter(F.col("page_type") == "PRODUCT"),
        # links of the fallback that are no products use up no places
        local.filter("geo_status = 'true' AND (NOT late OR page_type = 'PRODUCT')").withColumn("stored_type", stored).select(*_LINK, "stored_type"), new_links,
    )
    stages = [
        (placed, "geo_status = 'unresolved'", "geography"), (local, "geo_status = 'unresolved'", "geography"),
        (typed, "page_type = 'UNRESOLVED'", "page_type"),
        (local, "late AND geo_status = 'true' AND page_type = 'UNRESOLVED'", "category_link"),
    ]
    unresolved = [t.filter(test).select("query_id", "url", "pos", F.lit(stage).alias("stage")) for t, test, stage in stages]
    return grown.join(asked.select("query_id", "query"), "query_id"), reduce(DataFrame.union, unresolved)


_LINK = ["query_id", "url", "src_pos", "pos", "country"]


def fallback(categories: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Links that match the query on category pages of searches with too few product ``links``, without those already found."""
    low = pagetypes.low_yield(categories, links)
    about = categories.groupBy("query_id").agg(F.first("terms").alias("terms"), F.first("country").alias("country"))  # one value a search
    cleaned = pagetypes.fallback_links(categories, edges, low).withColumn("url", urls.drop_repeated_segments(F.col("url")))
    wanted = cleaned.join(about, "query_id").filter(urls.matches_query(F.col("url"), F.col("terms")))
    return keep_first(wanted, ["query_id", "url"], F.struct("src_pos", "pos")).join(links.select("query_id", "url"), ["query_id", "url"], "left_anti")


class SearchResult(NamedTuple):
    """Results of the whole job; hand ``unresolved`` to labelling, and its answers and ``decisions`` to ``store.record_decisions``."""

    offers: DataFrame  # ranked, one per product and search
    summaries: DataFrame  # one row per request
    unresolved: DataFrame  # (query_id, url, pos, stage)
    decisions: DataFrame  # prices found anew: (kind, key, value, decided_at)


def search_to_offers(
    queries: DataFrame, hits: DataFrame, edges: DataFrame, content: DataFrame, decisions: DataFrame,
    as_of: Column, responses: DataFrame | None = None, mode: str = "label", top: int | None = None,
    min_relevance: float = 0.2, **limits: int | None,
) -> SearchResult:
    """Ranked offers, summaries, open rows and new price decisions for any number of searches in one job.

    ``limits`` are those of ``typed_candidates``; ``top`` is the number of pages priced per search. ``decisions`` settle places, page types
    and prices. Relevance scores are computed, not looked up: they cost less than the join with stored ones and are the same.
    """
    typed, unresolved = typed_candidates(queries, hits, edges, decisions, as_of, mode, **limits)
    gated = relevance.relevance_gate(relevance.score_candidates(typed), min_relevance, top)
    named = gated.withColumn("identified_product_name", F.coalesce("original_title", "query"))
    named = cut_lineage(named)
    stored = pricing.stored_prices(named, decisions, as_of, pinned=True)
    # pages are gathered per URL by their own steps, so others are left out below these
    answers = None if responses is None else among(responses, "url", named)
    priced = cut_lineage(pricing.extract_prices(named, among(content, "url", named), stored, answers))
    unique = offers.dedupe_names(offers.first_per_url(priced))
    return SearchResult(
        offers.rank_offers(unique), offers.search_summaries(queries, unique), unresolved, pricing.price_decisions(priced, as_of)
    )
