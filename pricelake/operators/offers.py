"""Offer consolidation: first per URL, fuzzy name dedupe, ranking, one result set per search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import names
from pricelake.functions.text import product_name_key
from pricelake.operators.ordered import placed, ranked
from pricelake.operators.urltable import keep_first
from pricelake.session import cut_lineage


def first_per_url(offers: DataFrame) -> DataFrame:
    """Successful offers, the first per search and URL."""
    return keep_first(offers.filter("price_extraction.success"), ["query_id", "url"])


# -- fuzzy name dedupe -----------------------------------------------------------------------
def candidate_names(distinct: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs (short, long) of the distinct names that share a piece where a match can have it; loses no match.

    A pair may come up at more than one key. No thresholds below two thirds: pieces would be empty, and lengths alone decide.
    """
    own = distinct.select(F.col("name").alias("short"), F.explode(names.piece_keys(F.col("name"), threshold)).alias("key"))
    met = distinct.select(F.col("name").alias("long"), F.explode(names.meeting_keys(F.col("name"), threshold)).alias("key"))
    # of two names of one length, each can be the shorter one
    once = (F.length("short") < F.length("long")) | (F.col("short") < F.col("long"))
    return own.join(met, "key").filter(once).select("short", "long")


def similar_names(keyed: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Edges (query_id, later, earlier) between distinct names whose match ratio reaches the threshold.

    ``keyed(query_id, name, pos)`` holds distinct names. Names are compared once for all searches: candidates share a
    piece (exact), the edit-distance bound removes most of them inside the JVM, and only the rest is compared in
    Python, both ways, since the ratio depends on which name comes later. Pairs then go back to the searches that hold both.
    """
    pairs = (
        candidate_names(keyed.select("name").distinct(), threshold)
        .filter(names.may_match(F.col("short"), F.col("long"), threshold))
        .distinct()
    )
    ways = F.array(*[
        F.struct(F.col(l).alias("l_name"), F.col(e).alias("e_name"), names.match_ratio(l, e).alias("ratio"))
        for l, e in (("short", "long"), ("long", "short"))
    ])
    alike = pairs.select(F.explode(ways).alias("w")).select("w.*").filter(F.col("ratio") >= threshold)
    later = keyed.select("query_id", F.col("name").alias("l_name"), F.col("pos").alias("later"))
    earlier = keyed.select("query_id", F.col("name").alias("e_name"), F.col("pos").alias("earlier"))
    return (
        alike.join(later, "l_name").join(earlier, ["query_id", "e_name"])
        .filter(F.col("earlier") < F.col("later"))
        .select("query_id", "later", "earlier")
    )


def name_leaders(keyed: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Leader of every distinct name in input order: (query_id, name, pos, leader).

    A name leads when no earlier leader matches it; otherwise it joins its earliest matching leader.
    Solved in rounds over the similarity edges: names whose earlier neighbours are all followers become
    leaders, their neighbours follow.
    """
    edges = cut_lineage(similar_names(keyed, threshold))
    open_edges, followers = edges, None
    while not open_edges.isEmpty():
        waiting = open_edges.select("query_id", F.col("later").alias("n")).distinct()
        sources = open_edges.select("query_id", F.col("earlier").alias("n")).distinct()
        leaders = sources.join(waiting, ["query_id", "n"], "left_anti")
        found = (
            open_edges.join(leaders.withColumnRenamed("n", "earlier"), ["query_id", "earlier"], "left_semi")
            .select("query_id", F.col("later").alias("n"))
            .distinct()
        )
        found = cut_lineage(found)
        followers = found if followers is None else followers.unionByName(found)
        open_edges = cut_lineage(
            open_edges.join(found.withColumnRenamed("n", "later"), ["query_id", "later"], "left_anti").join(
                found.withColumnRenamed("n", "earlier"), ["query_id", "earlier"], "left_anti"
            )
        )
    if followers is None:
        return keyed.select("query_id", "name", "pos", F.col("pos").alias("leader"))
    joined = (
        edges.join(followers.withColumnRenamed("n", "earlier"), ["query_id", "earlier"], "left_anti")
        .groupBy("query_id", F.col("later").alias("pos"))
        .agg(F.min("earlier").alias("leader"))
    )
    return keyed.join(joined, ["query_id", "pos"], "left").select(
        "query_id", "name", "pos", F.coalesce("leader", "pos").alias("leader")
    )


_RUN = 4096  # offers in a first summary
_FAN = 16  # summaries merged at once
_STATE = ("pos", "price", "currency", "confidence")


def _summary(frame: pd.DataFrame) -> pd.DataFrame:
    """Summary of consecutive blocks: the offers that can act first on an incoming state, each with the state that the
    blocks end in from there.

    An offer can act first only if it is cheaper than all before it in its currency, or surer than all before it that
    an incoming state of some currency (or of none of these) sees as another one. Its end is followed through the later
    blocks: each hands over the end of its first acting offer. A row is a block of its own at first; summaries
    of summaries are made the same way, so any grouping of consecutive blocks gives one result.
    """
    rows = frame.sort_values(["block", "pos"]).to_dict("records")

    def beats(new: dict, held: dict) -> bool:
        if new["currency"] == held["currency"]:
            return new["price"] < held["price"]
        return new["confidence"] > held["confidence"]

    needed = set()
    for currency in [*sorted({r["currency"] for r in rows}), None]:
        low, top = float("inf"), float("-inf")
        for i, r in enumerate(rows):
            if r["currency"] == currency:
                if r["price"] < low:
                    low = r["price"]
                    needed.add(i)
            elif r["confidence"] > top:
                top = r["confidence"]
                needed.add(i)
    out = []
    for i in sorted(needed | {0}):
        held, done = {k: rows[i][f"end_{k}"] for k in _STATE}, rows[i]["block"]
        for r in rows[i + 1 :]:
            if r["block"] != done and beats(r, held):
                held, done = {k: r[f"end_{k}"] for k in _STATE}, r["block"]
        out.append({**rows[i], **{f"end_{k}": held[k] for k in _STATE}})
    return pd.DataFrame(out)


def _large_winners(rows: DataFrame) -> DataFrame:
    """(query_id, leader, winner) of clusters of any size: runs by rank are summarised by many tasks, then summaries of
    consecutive runs are merged ``_FAN`` at a time until one is left."""
    ends = {f"end_{k}": F.col(k) for k in _STATE}
    now = ranked(rows, ["query_id", "leader"], ["pos"], "block").withColumns({"run": F.floor((F.col("block") - 1) / _RUN), **ends})
    columns = ["query_id", "leader", "run", "block", *_STATE, *ends]
    now = now.select(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema)
    while True:
        now = cut_lineage(now.groupBy("query_id", "leader", "run").applyInPandas(_summary, schema))
        if now.filter("run > 0").isEmpty():
            break
        now = now.withColumns({"block": F.col("run"), "run": F.floor(F.col("run") / _FAN)}).select(*columns)
    return now.groupBy("query_id", "leader").agg(F.min_by("end_pos", F.struct("block", "pos")).alias("winner"))


_SMALL_CLUSTER = 1000


def _small_winner() -> Column:
    """Ordered fold inside one row, for clusters of at most ``_SMALL_CLUSTER`` offers."""
    row = F.struct("pos", "price", "currency", "confidence")
    start = F.lit(None).cast("struct<pos: bigint, price: double, currency: string, confidence: double>")

    def step(held: Column, new: Column) -> Column:
        cheaper = (new["currency"] == held["currency"]) & (new["price"] < held["price"])
        surer = (new["currency"] != held["currency"]) & (new["confidence"] > held["confidence"])
        return F.when(held.isNull() | cheaper | surer, new).otherwise(held)

    return F.aggregate(F.array_sort(F.collect_list(row)), start, step)["pos"]


def cluster_winners(members: DataFrame) -> DataFrame:
    """Winning offer per cluster: (query_id, leader, winner).

    In order: same currency, the cheaper one; other currency, the more confident one. A cluster in one
    currency is a plain minimum (combines before the shuffle). A small mixed one is folded in its row; a larger one is
    cut into runs by rank, whose summaries are merged in a tree, so no cluster is gathered whole. All give the same result.
    """
    rows = members.withColumn("currency", F.coalesce("currency", F.lit(""))).withColumn(
        "confidence", F.coalesce("confidence", F.lit(0.0))
    )
    # written once: three ways read it, and the usual case without a large cluster is seen from it
    kinds = cut_lineage(rows.groupBy("query_id", "leader").agg(
        (F.min("currency") == F.max("currency")).alias("plain"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("pos", F.struct("price", "pos")).alias("winner"),
    ))
    plain = kinds.filter("plain").select("query_id", "leader", "winner")
    pick = lambda test: rows.join(kinds.filter(test).select("query_id", "leader"), ["query_id", "leader"], "left_semi")
    small = pick(f"NOT plain AND n <= {_SMALL_CLUSTER}").groupBy("query_id", "leader").agg(_small_winner().alias("winner"))
    winners, big = plain.unionByName(small), f"NOT plain AND n > {_SMALL_CLUSTER}"
    if kinds.filter(big).isEmpty():
        return winners
    return winners.unionByName(_large_winners(pick(big).select("query_id", "leader", *_STATE)))


def dedupe_names(offers: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One offer per product per search; offers without a usable name are all kept.

    Equal names always share a leader, so only distinct names are compared. Offers are ordered by position, then URL, so
    equal positions do no harm; ``leader`` is the position of the offer whose name leads the cluster.
    """
    shown = offers.withColumn("name", product_name_key(F.col("product_name"))).withColumn("pos", F.col("pos").cast("bigint"))
    # offers end a long job and are read several times below (once to find the range borders), so they are written first
    ordered = cut_lineage(placed(cut_lineage(shown), ["query_id"], ["pos", "url"], "__place"))
    keyed = ordered.withColumnsRenamed({"pos": "__shown", "__place": "pos"})
    named = keyed.filter(F.col("name") != "")
    first = F.min(F.struct("pos", "__shown")).alias("first")
    distinct = cut_lineage(named.groupBy("query_id", "name").agg(first).select("query_id", "name", "first.pos", "first.__shown"))
    leaders = name_leaders(distinct.drop("__shown"), threshold).select("query_id", "name", "leader")
    members = cut_lineage(
        named.join(leaders, ["query_id", "name"]).select(
            "query_id", "leader", "pos",
            F.col("price_extraction.price").alias("price"),
            F.col("price_extraction.currency").alias("currency"),
            F.col("price_extraction.confidence").alias("confidence"),
        )
    )
    # a leader is the first offer of its name, so its position stands among the names
    leading = distinct.select("query_id", F.col("pos").alias("leader"), "__shown")
    winners = cluster_winners(members).join(leading, ["query_id", "leader"])
    kept = winners.select("query_id", F.col("winner").alias("__place"), F.col("__shown").alias("leader")).unionByName(
        keyed.filter(F.col("name") == "").select("query_id", F.col("pos").alias("__place"), F.col("__shown").alias("leader"))
    )
    return ordered.drop("name").join(kept, ["query_id", "__place"]).select(*offers.columns, "leader")


# -- ranking ---------------------------------------------------------------------------------
def rank_offers(offers: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Cheapest first per search, missing prices last, stable by position.

    ``rates(currency, rate)`` adds ``price_base`` and ranks by it; without it currencies are mixed.
    """
    rows = offers.withColumn("__price", F.col("price_extraction.price"))
    if rates is not None:
        rows = rows.join(
            rates.select(F.col("currency").alias("__c"), "rate"), F.col("price_extraction.currency") == F.col("__c"), "left"
        ).withColumn("price_base", F.col("__price") * F.col("rate")).withColumn("__price", F.col("price_base")).drop("__c", "rate")
    rows = rows.withColumn("sort_price", F.coalesce("__price", F.lit(float("inf")))).drop("__price")
    return ranked(rows, ["query_id"], ["sort_price", "pos", "url"], "rank")


def search_summaries(requests: DataFrame, offers: DataFrame) -> DataFrame:
    """One row per request, also for requests without an offer."""
    found = offers.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("offers"), F.min("price_extraction.price").alias("best_price")
    )
    return (
        requests.join(found, "query_id", "left")
        .withColumn("offers", F.coalesce("offers", F.lit(0)))
        .withColumn("success", F.col("offers") > 0)
    )
