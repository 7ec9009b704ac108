"""The whole job gathers less and gives the same rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pricelake.functions import rules, urls
from pricelake.operators import candidates, store
from pricelake.session import among


def test_rows_out_of_reach_of_the_host_cap_are_dropped_and_the_capped_rows_stay(spark):
    rng = random.Random(11)
    heads = ["https://shop.com.uy", "https://www.shop.com.uy", "https://tienda.com.uy", "https://facebook.com", "HTTPS://Shop.com.uy", "https://shop.com.uy."]
    tails = ["", "/", "?x=1", "/blog/x", " ", "›b", "/http://a.com/"]
    rows = [
        (rng.choice([1, 2, None]), f"{rng.choice(heads)}/producto/{rng.randrange(3000)}{rng.choice(tails) if rng.random() < 0.2 else ''}", rng.choice([None] + [rng.randrange(5000)] * 40), f"t{i}")
        for i in range(6000)
    ] + [(3, f"https://few.com.uy/{i % 2}", i, "t") for i in range(50)] + [(1, None, 1, "t"), (1, "no url", 2, "t")]
    hits = spark.createDataFrame(rows, "query_id int, url string, pos int, original_title string")
    for cap in (1, 4):
        reached = candidates.within_reach(hits, cap)
        assert reached.columns == hits.columns and 0 < reached.count() < 5000
        kept = lambda df: sorted((str(r.query_id), r.host, str(r.pos), r.url, r.host_rank) for r in candidates.host_cap(candidates.pattern_filter(urls.clean_rows(df)), cap).collect())
        assert kept(reached) == kept(hits)


def test_only_rows_of_kept_hosts_are_built_past_the_cap(spark):
    """The cut stands below the steps that build long columns, and wanted keys below those that gather rows by key."""
    numbers = spark.range(2000).withColumn("url", F.concat(F.lit("https://a.com.uy/producto/"), F.col("id").cast("string")))
    hits = numbers.select(F.lit(1).alias("query_id"), "url", F.col("id").alias("pos"), F.upper("url").alias("original_title"))
    lines = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = lambda plan, what: next(i for i, line in enumerate(plan) if what in line)
    plan = lines(candidates.within_reach(hits, 2))
    assert at(plan, "upper(") < at(plan, "Join LeftAnti")
    pages = numbers.groupBy("url").agg(F.max("id").alias("last"))
    plan = lines(among(pages, "url", numbers.filter("id < 3")))
    assert at(plan, "Aggregate") < at(plan, "Join LeftSemi")
    assert among(pages, "url", numbers.filter("id < 3")).count() == 3


def test_decisions_for_requests_written_down_are_those_of_all(spark):
    day = "2024-01-02 00:00:00"
    made = [("geo", f"k{i % 40}", str(i % 3), f"2024-01-01 23:{i % 60:02d}:00") for i in range(200)] + [("price", "k1", "9", "2024-01-01 23:59:00")]
    known = spark.createDataFrame(made, "kind string, key string, value string, at string").withColumn("decided_at", F.to_timestamp("at")).drop("at")
    asked = spark.createDataFrame([("geo", f"k{i}") for i in (1, 1, 5, 39, 77)] + [("page_type", "k1")], "kind string, key string")
    got = [sorted(map(str, store.reuse_decisions(asked, known, F.lit(day).cast("timestamp"), pinned).collect())) for pinned in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 6


def test_url_patterns_and_their_short_ways_agree(spark):
    words = ["help", "Blog", "ayuda", "x.pdf", "x.PDF\n", "category", "secciones", "api", "help\n", "pdf", ""]
    given = [f"{h}{a}{b}{e}" for h in ("https://a.com.uy/", "HTTPS://www.A.com/", "a/", "") for a in words for b in ("", "/", "/x", "/help/") for e in ("", "/", "?q", "//")]
    df = spark.createDataFrame([(u,) for u in given], "u string")
    whole = "/(?:" + "|".join(rules.EXCLUDE_SEGMENTS) + ")/|" + rules.EXCLUDE_LISTING_PATTERN + r"|\.(?:" + "|".join(rules.EXCLUDE_EXTENSIONS) + ")$"
    u = F.col("u")
    assert df.filter(~candidates.is_excluded(u).eqNullSafe(F.lower(u).rlike(whole))).count() == 0
    for drop in (True, False):
        assert df.filter(~urls.normalize(u, drop).eqNullSafe(urls._any_key(u, drop, False))).count() == 0
    sound = df.filter(urls.sound_host(u) != "")
    assert sound.count() and sound.filter(urls.sound_host(u) != F.split_part(urls.normalize(u, True), F.lit("/"), F.lit(3))).count() == 0
