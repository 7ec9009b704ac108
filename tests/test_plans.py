"""What the plans must and must not contain."""

from __future__ import annotations

import pytest

from checks import QUERIES
from tests.conftest import SMALL

NATIVE = [
    "urls_sanitized", "urls_normalized", "urls_clean_table", "links_harvest", "host_cap", "relevance_gate", "result_budget",
    "price_direct", "price_parse", "price_cascade", "geo_validate", "page_types", "category_expansion", "offers_first_per_url",
    "page_upsert", "ttl_lookup", "tiered_lookup", "count_over_time", "counter_increase", "alert_intervals", "halving_average",
    "search_fanout", "domain_blocklist",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in NATIVE if n in QUERIES])
def test_native_plans(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for banned in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert banned not in plan, banned


def test_caps_cut_before_the_shuffle(spark):
    for name in ("host_cap", "result_budget", "relevance_gate", "category_expansion"):
        assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, SMALL)), name


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["retention_kept"](spark, SMALL))
    assert "GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp>" in plan
    contains = plan_of(QUERIES["pages_by_domain"](spark, SMALL))
    assert "StringContains(url,example.org)" in contains


def test_clean_up_stands_once(spark):
    """Filters above the URL clean-up use its value; the repair chain is not copied into them."""
    for name in ("relevance_gate",):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("›‹»«]*, 0)") == 1, name


def test_first_wins_combines_before_the_shuffle(spark):
    plan = plan_of(QUERIES["urls_dedupe_first"](spark, SMALL))
    assert "partial_min_by" in plan
