"""Page store and time-to-live tables."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelake.functions import rules
from pricelake.functions.text import blank_to_null
from pricelake.operators.ordered import ranked
from pricelake.session import among, cut_lineage


# -- pages -----------------------------------------------------------------------------------
def append_versions(versions: DataFrame, location: str) -> None:
    """Add page versions to a table of versions; nothing that is there is read or written again."""
    versions.write.mode("append").parquet(location)


def current_pages(spark: SparkSession, location: str, fetched_at: str = "fetched_at") -> DataFrame:
    """The page of each URL from a table of versions (url, content columns, ``fetched_at``): newest content, first crawl."""
    versions = spark.read.parquet(location)
    at = F.col(fetched_at)
    empty = versions.limit(0).withColumns({"crawled_at": at, "last_updated": at}).drop(fetched_at)
    return upsert_pages(empty, versions, fetched_at)


def upsert_pages(base: DataFrame, delta: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Merge new page versions by ``url``.

    The newest version replaces every content column, ``crawled_at`` stays the first crawl,
    ``last_updated`` is set once a page was replaced. A vector survives while the text is unchanged.
    One aggregation that combines before the shuffle, so a page crawled a million times is cheap.
    """
    content = [c for c in base.columns if c not in ("url", "crawled_at", "last_updated")]
    old = base.select("*", F.coalesce("last_updated", "crawled_at").alias("__at"), F.lit(0).alias("__new"))
    new = delta.select(
        "url",
        *[F.col(c) if c in delta.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in content],
        F.col(fetched_at).alias("crawled_at"),
        F.lit(None).cast("timestamp").alias("last_updated"),
        F.col(fetched_at).alias("__at"),
        F.lit(1).alias("__new"),
    )
    # maps have no hash; as text they have one, so equal times have a fixed winner
    hashable = [F.to_json(c) if isinstance(base.schema[c].dataType, T.MapType) else F.col(c) for c in content]
    order = F.struct("__at", "__new", F.xxhash64(*hashable))
    aggs = [
        F.max_by(F.struct(*content), order).alias("__row"),
        F.min("crawled_at").alias("crawled_at"),
        F.max("__at").alias("__latest"),
        F.max("last_updated").alias("__was"),
        F.count(F.lit(1)).alias("__versions"),
        F.sum("__new").alias("__added"),
    ]
    keep_vector = "embedding" in content and "full_text" in content
    if keep_vector:
        has_vector = F.when(
            F.col("embedding").isNotNull(), F.struct("__at", F.xxhash64("full_text").alias("h"))
        )
        aggs.append(
            F.max_by(F.struct(F.xxhash64("full_text").alias("h"), "embedding"), has_vector).alias("__vector")
        )
    merged = old.unionByName(new).groupBy("url").agg(*aggs)
    columns: dict[str, Column] = {c: F.col(f"__row.{c}") for c in content}
    if keep_vector:
        columns["embedding"] = F.coalesce(
            columns["embedding"],
            F.when(F.col("__vector.h") == F.xxhash64(F.col("__row.full_text")), F.col("__vector.embedding")),
        )
    updated = F.when((F.col("__versions") > 1) & (F.col("__added") > 0), F.col("__latest"))
    return merged.select(
        "url",
        *[columns[c].alias(c) for c in content],
        "crawled_at",
        F.coalesce(updated, F.col("__was")).alias("last_updated"),
    )


def lookup_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Every requested URL with its page or ``not_found``; text falls back to the main content."""
    body = F.coalesce(blank_to_null(F.col("full_text")), F.col("main_content"))
    found = pages.select("url", "title", body.alias("text"), F.lit(True).alias("__hit"))
    return (
        requests.join(found, "url", "left")
        .withColumn("status", F.when(F.col("__hit"), "found").otherwise("not_found"))
        .drop("__hit")
    )


def lookup_counts(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("status") == "found").alias("found"),
    )


def context_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Eight context fields of the pages in a URL list. Spark broadcasts the list when it is small."""
    fields = [
        "url", "title", "description", "main_content", "headers", "structured_data", "content_language",
        F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("last_modified"),
    ]
    return pages.join(urls.select("url").distinct(), "url", "left_semi").select(*fields)


def ordered_batches(pages: DataFrame, key: str = "url", size: int = 100, columns: list[str] | None = None) -> DataFrame:
    """Rows in key order with a 0-based index and batch number, without one global window."""
    kept = [key] + [c for c in (columns or []) if c != key]
    return ranked(pages.select(*kept), [], [key], "row_index").select(
        *kept,
        (F.col("row_index") - 1).alias("row_index"),
        F.floor((F.col("row_index") - 1) / size).alias("batch"),
    )


def clear_table(pages: DataFrame, location: str) -> None:
    """Empty the table but keep its schema."""
    pages.limit(0).write.mode("overwrite").parquet(location)


def _cutoff(as_of: datetime | Column, days: int) -> Column:
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return moment - F.expr(f"INTERVAL {int(days)} DAYS")


def retain_pages(pages: DataFrame, as_of: datetime | Column, days: int = 30, ts: str = "crawled_at") -> DataFrame:
    """Rows that survive. A plain comparison, so it reaches the scan; with a table partitioned by crawl
    date only border folders are rewritten.
    """
    return pages.filter((F.col(ts) >= _cutoff(as_of, days)) | F.col(ts).isNull())


def retention_counts(pages: DataFrame, as_of: datetime | Column, days: int = 30, ts: str = "crawled_at") -> DataFrame:
    gone = F.coalesce(F.col(ts) < _cutoff(as_of, days), F.lit(False))
    return pages.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


# retention of a table written by day (``sources.pages.write_pages``)
def _days(pages: DataFrame, as_of: datetime | Column, days: int, by: str) -> tuple[Column, Column]:
    """Tests of the folder alone: wholly older, and the one the cutoff falls in."""
    border = F.to_date(_cutoff(as_of, days))
    return F.coalesce(F.col(by) < border, F.lit(False)), F.coalesce(F.col(by) == border, F.lit(False))


def folder_retention_counts(
    spark: SparkSession, location: str, as_of: datetime | Column, days: int = 30, ts: str = "crawled_at", by: str = "crawl_date"
) -> DataFrame:
    """Rows (deleted, kept) of a table written by day. Rows of whole folders are counted from file footers; times are read in the
    border folder alone."""
    pages = spark.read.schema(f"{ts} timestamp, {by} date").parquet(location)
    older, border = _days(pages, as_of, days, by)
    whole = pages.filter(~border).select(older.alias("gone")).agg(F.count_if("gone").alias("deleted"), F.count_if(~F.col("gone")).alias("kept"))
    parts = whole.unionByName(retention_counts(pages.filter(border), as_of, days, ts))
    return parts.agg(F.sum("deleted").alias("deleted"), F.sum("kept").alias("kept"))


def delete_old_folders(
    spark: SparkSession, location: str, as_of: datetime, days: int = 30, ts: str = "crawled_at", by: str = "crawl_date"
) -> tuple[int, int]:
    """Delete rows older than ``days`` from a table written by day; (deleted, kept) rows.

    Wholly older folders go by name, unread. Only the folder the cutoff falls in is read and, where it loses rows, written again from a
    checkpoint; all other files stay as they are. Rows without a time stay. Days are those of the session time zone,
    as in ``write_pages``. Run again after a loss, it ends in the same table. A table without files gives (0, 0).
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(location)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {p.getName().partition("=")[2]: p for p in (s.getPath() for s in files.listStatus(root)) if p.getName().startswith(f"{by}=")}
    if not folders:
        return 0, 0
    deleted, kept = folder_retention_counts(spark, location, as_of, days, ts, by).first()
    border = spark.range(1).select(F.to_date(_cutoff(as_of, days)).cast("string")).first()[0]
    for day, folder in folders.items():
        if re.fullmatch(r"\d{4}-\d\d-\d\d", day) and day < border:
            files.delete(folder, True)
    if border in folders:
        edge = spark.read.option("basePath", location).parquet(folders[border].toString())
        loses, stays = retention_counts(edge, as_of, days, ts).first()
        if loses and stays:
            rest = cut_lineage(retain_pages(edge, as_of, days, ts))
            rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(location)
        elif loses:
            files.delete(folders[border], True)
    return deleted, kept


def recent_pages(pages: DataFrame, n: int, ts: str = "crawled_at", tie: str = "url") -> DataFrame:
    return pages.orderBy(F.col(ts).desc(), F.col(tie)).limit(n)


def pages_by_domain(pages: DataFrame, domain: str) -> DataFrame:
    """Pages with ``domain`` anywhere in the URL."""
    return pages.filter(F.col("url").contains(domain))


# -- decisions -------------------------------------------------------------------------------
def decision_key(*parts: Column) -> Column:
    # never null, which Spark cannot know of a hash: it would test for null by hashing once more
    return F.coalesce(F.sha2(F.concat_ws("|", *parts), 256), F.lit(""))


def ttl_seconds(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.DECISION_TTL.items() for x in pair])
    return F.try_element_at(table, kind)


def reuse_decisions(requests: DataFrame, decisions: DataFrame, as_of: Column, pinned: bool = False) -> DataFrame:
    """Latest live decision per (kind, key); ``hit`` false marks the miss set.

    Expiry is filtered before the aggregation, so dead rows never reach the shuffle. Nor do decisions that nobody asks for where
    the requests are ``pinned``: they are written down already, so their keys are read ahead, and broadcast while they are few.
    """
    alive = decisions.filter(
        (F.col("decided_at") <= as_of)
        & (F.unix_micros("decided_at") > F.unix_micros(as_of) - ttl_seconds(F.col("kind")).cast("long") * 1000000)
    )
    if pinned:
        alive = among(alive, "key", requests)
    latest = alive.groupBy("kind", "key").agg(
        F.max_by("value", F.struct("decided_at", "value")).alias("value"), F.max("decided_at").alias("decided_at")
    )
    return requests.join(latest, ["kind", "key"], "left").withColumn("hit", F.col("decided_at").isNotNull())


def record_decisions(decisions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Write back: newest decision per key; failed results are never stored."""
    usable = fresh.filter(~F.coalesce(F.col("value").startswith("ERROR_"), F.lit(True)))
    both = decisions.unionByName(usable.select(*decisions.columns))
    return (
        both.groupBy("kind", "key")
        .agg(F.max_by(F.struct("value", "decided_at"), F.struct("decided_at", "value")).alias("r"))
        .select("kind", "key", "r.value", "r.decided_at")
    )


# -- tiers -----------------------------------------------------------------------------------
def tiered_lookup(
    requests: DataFrame, memory: DataFrame, cache: DataFrame, stored: DataFrame, as_of: Column,
    memory_ttl: int = 300, cache_ttl: int = 3600,
) -> DataFrame:
    """First tier that can answer: short-lived, cached, stored, else ``miss``.

    The tiers are reduced to one row per URL in one aggregation, so there is a single join.
    """
    body = F.coalesce(
        blank_to_null(F.col("text")), blank_to_null(F.col("full_text")), F.coalesce("main_content", F.lit(""))
    )

    def tier(df: DataFrame, rank: int, name: str, ttl: int | None) -> DataFrame:
        live = df
        if ttl is not None:
            live = df.filter(
                (F.col("saved_at") <= as_of)
                & (F.unix_micros("saved_at") > F.unix_micros(as_of) - ttl * 1000000)
            )
        return live.select("url", body.alias("text"), "saved_at", F.lit(rank).alias("rank"), F.lit(name).alias("tier"))

    every = (
        tier(memory, 1, "memory", memory_ttl)
        .unionByName(tier(cache, 2, "cache", cache_ttl))
        .unionByName(tier(stored, 3, "stored", None))
    )
    best = every.groupBy("url").agg(
        F.min_by(F.struct("tier", "text"), F.struct("rank", -F.unix_micros("saved_at"), "text")).alias("r")
    )
    return requests.join(best, "url", "left").select(
        *requests.columns,
        F.coalesce("r.tier", F.lit("miss")).alias("tier"),
        F.col("r.text").alias("text"),
    )


def promotions(looked_up: DataFrame) -> DataFrame:
    """Hits of the slower tiers that move up to the first one."""
    return looked_up.filter(F.col("tier").isin("cache", "stored")).select("url", "text").distinct()


def tier_stats(looked_up: DataFrame) -> DataFrame:
    """Hits per tier and hit rate in percent."""
    return looked_up.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("tier") == "memory").alias("memory_hits"),
        F.count_if(F.col("tier") == "cache").alias("cache_hits"),
        F.count_if(F.col("tier") == "stored").alias("stored_hits"),
        F.count_if(F.col("tier") == "miss").alias("misses"),
    ).withColumn(
        "hit_rate",
        F.when(
            F.col("requests") > 0, F.round((F.col("requests") - F.col("misses")) / F.col("requests") * 100, 2)
        ).otherwise(0.0),
    )
