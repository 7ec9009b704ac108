"""The URL table job: one narrow stage of Column expressions, then order-preserving dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import urls


def clean_urls(table: DataFrame, url: str = "url", terms: str | None = None) -> DataFrame:
    """Add parts, sanitized and normalized form, host and the URL flags to every row."""
    want = F.col(terms) if terms else None
    clean = F.col("sanitized")
    site = (
        F.when(urls.is_marketplace_listing(clean), "listing")
        .when(urls.is_marketplace_product(clean), "product")
        .when(urls.is_single_product(clean), "single_product")
        .otherwise("other")
    )
    return (
        urls.with_sanitized(table, url, "sanitized")
        .withColumn("parts", urls.url_parts(clean))
        .withColumn("normalized", urls.normalize(clean))
        .withColumn("dedupe_key", urls.normalize(clean, drop_query=True))
        .withColumn("host", urls.host(clean))
        .withColumn("is_product", urls.is_product_url(clean, want))
        .withColumn("matches_query", urls.matches_query(clean, want) if want is not None else F.lit(True))
        .withColumn("site_kind", site)
        .withColumn("reject_reason", F.when(clean.isNull(), "unusable_url"))
    )


def keep_first(table: DataFrame, keys: list[str], pos: str | Column = "pos") -> DataFrame:
    """First row per key by ``pos``; combines before the shuffle, so repeats never travel."""
    at = F.col(pos) if isinstance(pos, str) else pos
    rest = [c for c in table.columns if c not in keys]
    return (
        table.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), at).alias("__first"))
        .select(*keys, *[F.col(f"__first.`{c}`").alias(c) for c in rest])
        .select(*table.columns)
    )
