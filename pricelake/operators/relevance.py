"""Relevance scores and the relevance gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.functions import geo, text, urls


def relevance_score(query: Column, terms: Column, url: Column, title: Column, snippet: Column) -> Column:
    """0.4 URL match + 0.3 title overlap + 0.2 snippet overlap + 0.1 verbatim query, at most 1.

    ``terms``, ``title`` and ``snippet`` are token arrays.
    """
    text_url = F.coalesce(url, F.lit(""))
    score = (
        F.when(urls.matches_query(text_url, terms), 0.4).otherwise(0.0)
        + 0.3 * text.overlap_ratio(terms, title)
        + 0.2 * text.overlap_ratio(terms, snippet)
        + F.when((query != "") & F.contains(F.lower(text_url), F.lower(query)), 0.1).otherwise(0.0)
    )
    return F.least(F.lit(1.0), score)


def score_candidates(candidates: DataFrame, fold_accents: bool = False) -> DataFrame:
    """Add relevance, location and combined score (columns query, url, original_title, original_snippet).

    Narrow: tokens are columns of their own, so each text is split once.
    """
    tokens = lambda c: text.relevance_tokens(F.col(c), fold_accents)
    place = geo.location_signal(F.col("url"), F.col("original_title"), F.col("original_snippet"))
    return (
        candidates.withColumn("__q", tokens("query"))
        .withColumn("__t", tokens("original_title"))
        .withColumn("__s", tokens("original_snippet"))
        .withColumn(
            "__rel", relevance_score(F.col("query"), F.col("__q"), F.col("url"), F.col("__t"), F.col("__s"))
        )
        .withColumn("location_score", place)
        .withColumn("relevance_score", F.round("__rel", 4))
        .withColumn("combined_score", F.round(F.least(F.lit(1.0), F.col("__rel") + 0.2 * F.col("location_score")), 4))
        .drop("__q", "__t", "__s", "__rel")
    )


def relevance_gate(scored: DataFrame, min_relevance: float = 0.2, top: int | None = None) -> DataFrame:
    """Best ``top`` candidates per search at or above the bar; a search with none above keeps its best. Without ``top``
    all of them, unranked.

    Ranks are taken per (search, passed) first, so tasks cut before the shuffle and the per-search
    check looks at ``2 * top`` rows instead of the whole search.
    """
    passed = F.coalesce(F.col("relevance_score") >= min_relevance, F.lit(False))
    order = [F.col("combined_score").desc(), F.col("pos"), F.col("url")]
    if top is None:
        marked = scored.withColumn("__passed", passed)
        best = marked.groupBy("query_id").agg(F.max("__passed").alias("__any"))
        return marked.join(best, "query_id").filter(F.col("__passed") == F.col("__any")).select(*scored.columns)
    inside = Window.partitionBy("query_id", "__passed").orderBy(*order)
    best = (
        scored.withColumn("__passed", passed)
        .withColumn("rank", F.row_number().over(inside))
        .filter(F.col("rank") <= top)
    )
    any_passed = F.max("__passed").over(Window.partitionBy("query_id"))
    return (
        best.withColumn("__any", any_passed)
        .filter(F.col("__passed") == F.col("__any"))
        .drop("__passed", "__any")
    )
