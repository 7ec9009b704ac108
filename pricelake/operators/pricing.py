"""The price stage: candidates joined with page content, one cascade of Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import prices
from pricelake.functions.expr import let
from pricelake.functions.text import blank_to_null
from pricelake.operators.store import decision_key, reuse_decisions
from pricelake.operators.urltable import keep_first


def product_pages(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("page_type") == "PRODUCT")


def _from(source: str, value: Column) -> Column:
    """Tag a price with its source; null stays null."""
    return let(
        value,
        lambda v: F.when(v.isNotNull(), F.struct(F.lit(source).alias("source"), v.alias("price_extraction"))),
    )


def extract_prices(
    candidates: DataFrame,
    content: DataFrame,
    cached: DataFrame | None = None,
    responses: DataFrame | None = None,
    compat: bool = True,
    min_text: int = 50,
) -> DataFrame:
    """Offer per product page from the first source that answers.

    Order: reused decision, JSON-LD, meta tags, text, outside response. Only when none of them gives a price does
    the page fail, as ``no_content``, ``insufficient`` (text shorter than ``min_text``) or ``unresolved``. An answer for
    a page without enough text was read by machine: it must be a price, and a sane one. A catalogue answer keeps
    its first product. Failures are kept with their error, and answers below 0.6 are flagged for a second source.
    ``content(url, text, meta_tags, structured_data)``, ``cached(url, price_extraction)`` and, where it is there, ``product_name``,
    ``responses(url, raw_text)``. Expressions of later sources run only where earlier ones are null.
    """
    rows = product_pages(candidates).join(
        content.select("url", F.col("text").alias("__text"), "meta_tags", "structured_data", F.lit(True).alias("__page")),
        "url",
        "left",
    )
    if cached is not None:
        name = F.col("product_name") if "product_name" in cached.columns else F.lit(None).cast("string")
        rows = rows.join(cached.select("url", F.col("price_extraction").alias("__cached"), name.alias("__name")), "url", "left")
    else:
        rows = rows.withColumn("__cached", F.lit(None).cast(prices.RESULT)).withColumn("__name", F.lit(None).cast("string"))
    if responses is not None:
        rows = rows.join(responses.select("url", F.col("raw_text").alias("__answer")), "url", "left")
    else:
        rows = rows.withColumn("__answer", F.lit(None).cast("string"))

    text = F.coalesce("__text", F.lit(""))
    unread = F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) < min_text
    rows = rows.withColumn("__item", F.try_element_at(prices.catalogue_items(F.col("__answer")), F.lit(1)))
    stated = F.when(F.col("__item").isNotNull(), prices.catalogue_price(F.col("__item"), compat)).otherwise(
        prices.reparsed(prices.response_price(F.col("__answer")), compat)
    )
    sane = lambda p: p["success"] & prices.machine_price_reject(p["price"], p["currency"]).isNull()
    answer = F.when(F.col("__answer").isNotNull(), let(stated, lambda p: F.when(~unread | sane(p), p)))
    steps = [
        ("cached", F.when(F.col("__cached.success"), F.col("__cached"))),
        ("structured", prices.structured_price(F.col("structured_data"))),
        ("meta", prices.meta_price(F.col("meta_tags"))),
        ("text", prices.direct_price(F.col("__text"), compat)),
        ("response", answer),
        ("no_content", F.when(F.col("__page").isNull(), prices.failure(F.lit("Failed to retrieve page content from batch")))),
        (
            "insufficient",
            F.when(unread, prices.failure(F.concat(F.lit("Insufficient page content ("), F.length(text), F.lit(" chars)")))),
        ),
    ]
    tagged = [_from(name, value) for name, value in steps]
    last = F.struct(
        F.lit("unresolved").alias("source"), prices.failure(F.lit("No price found in content")).alias("price_extraction")
    )
    own_name = F.when(F.col("source") == "response", blank_to_null(F.col("__item.product_name"))).when(
        F.col("source") == "cached", blank_to_null(F.col("__name"))
    )
    return (
        rows.withColumn("__r", F.coalesce(*tagged, last))
        .withColumn("source", F.col("__r.source"))
        .withColumn("price_extraction", F.col("__r.price_extraction"))
        .withColumn(
            "needs_second_source",
            ~F.col("price_extraction.success") | (F.coalesce("price_extraction.confidence", F.lit(0.0)) < 0.6),
        )
        .withColumn("product_name", F.coalesce(own_name, blank_to_null(F.col("identified_product_name")), F.lit("Unknown Product")))
        .drop("__r", "__text", "__page", "__cached", "__name", "__answer", "__item", "meta_tags", "structured_data")
    )


def stored_prices(pages: DataFrame, decisions: DataFrame, as_of: Column, pinned: bool = False) -> DataFrame:
    """Live price decisions of the given pages, one row per URL that has one: (url, product_name, price_extraction).

    A value that is no JSON or holds no price counts as none. ``pinned`` as in ``reuse_decisions``.
    """
    asked = pages.select("url").distinct().withColumns({"kind": F.lit("price"), "key": decision_key("url")})
    value = F.from_json("value", f"product_name string, price_extraction {prices.RESULT}")
    known = reuse_decisions(asked, decisions, as_of, pinned).filter("hit").select("url", value.alias("v"))
    return known.filter("v.price_extraction.success").select("url", "v.product_name", "v.price_extraction")


def price_decisions(priced: DataFrame, decided_at: Column) -> DataFrame:
    """Prices that were found anew as decisions (kind, key, value, decided_at), the first per URL, for ``store.record_decisions``."""
    fresh = priced.filter("price_extraction.success AND source <> 'cached'")
    first = keep_first(fresh.select("url", "query_id", "pos", "product_name", "price_extraction"), ["url"], F.struct("pos", "query_id"))
    value = F.to_json(F.struct("product_name", "price_extraction"))
    return first.select(F.lit("price").alias("kind"), decision_key("url").alias("key"), value.alias("value"), decided_at.alias("decided_at"))


def catalogue_offers(responses: DataFrame, single_product: str, compat: bool = True) -> DataFrame:
    """Offers of multi-product answers ``{"products": [...]}``; a product page keeps the first one only.

    ``single_product`` names the boolean column that marks product pages.
    """
    rows = responses.select(
        *responses.columns, F.posexplode(prices.catalogue_items(F.col("raw_text"))).alias("product_pos", "p")
    ).filter(~F.col(single_product) | (F.col("product_pos") == 0))
    return rows.select(
        *responses.columns, "product_pos", F.col("p.product_name").alias("product_name"),
        prices.catalogue_price(F.col("p"), compat).alias("price_extraction"),
    )
