"""Checks: prices, offers, recovered answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import query, table
from checks.store import page_ops, rich_pages
from pricelake.functions import prices, rules, text
from pricelake.operators import offers as offer_ops
from pricelake.operators import pricing, responses

# price texts per part: Uruguayan, plain, US, symbols, thousands, and one that is no number
_TEXTS = """texts AS (SELECT p_partkey, p_retailprice, unnest(range(7)) AS kind, unnest([
      'U$S ' || translate(printf('%,.2f', p_retailprice), ',.', '.,'), '$' || p_partkey, printf('%,.2f', p_retailprice), 'UYU ' || printf('%.1f', p_retailprice),
      '€ 1.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0'), '1.234.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0'), 'consultar']) AS t FROM part)"""


def price_texts(spark, sf):
    price, key = F.col("p_retailprice"), F.col("p_partkey")
    us = F.format_number(price, 2)
    tail = F.lpad((key % 1000).cast("string"), 3, "0")
    kinds = F.array(
        F.concat(F.lit("U$S "), F.translate(us, ",.", ".,")),
        F.concat(F.lit("$"), key.cast("string")),
        us,
        F.concat(F.lit("UYU "), F.format_string("%.1f", price)),
        F.concat(F.lit("€ 1."), tail),
        F.concat(F.lit("1.234."), tail),
        F.lit("consultar"),
    )
    return table(spark, sf, "part", spread=True).select("p_partkey", "p_retailprice", F.posexplode(kinds).alias("kind", "t"))


_BARE = "regexp_replace(t, '[$€a-zA-Z\\s]', '', 'g')"
_PARSED = f"""try_cast(CASE WHEN contains({_BARE}, ',') AND contains({_BARE}, '.') THEN replace(replace({_BARE}, '.', ''), ',', '.')
      WHEN len(string_split({_BARE}, ',')) = 2 THEN CASE WHEN length(string_split({_BARE}, ',')[2]) <= 2 THEN replace({_BARE}, ',', '.') ELSE replace({_BARE}, ',', '') END
      WHEN len(string_split({_BARE}, '.')) = 2 THEN CASE WHEN length(string_split({_BARE}, '.')[2]) <= 2 THEN {_BARE} ELSE replace({_BARE}, '.', '') END
      ELSE {_BARE} END AS DOUBLE)"""


@query("price_parse", f"WITH {_TEXTS} SELECT p_partkey, kind, round({_PARSED}, 6) AS price FROM texts")
def price_parse(spark, sf):
    return price_texts(spark, sf).select("p_partkey", "kind", F.round(prices.parse_price(F.col("t")), 6).alias("price"))


@query("price_round_trip", "SELECT p_partkey, p_retailprice AS compat, p_retailprice AS plain, p_retailprice AS us FROM part")
def price_round_trip(spark, sf):
    us = F.format_number("p_retailprice", 2)
    uy = F.concat(F.lit("U$S "), F.translate(us, ",.", ".,"))
    return table(spark, sf, "part", spread=True).select(
        "p_partkey",
        prices.parse_price(uy).alias("compat"),
        prices.parse_price(uy, compat=False).alias("plain"),
        prices.parse_price(us, compat=False).alias("us"),
    )


@query("price_direct", """WITH t AS (SELECT p_partkey, p_retailprice AS price, unnest(range(4)) AS kind, unnest([
      'Oferta ' || p_name || ' U$S ' || translate(printf('%,.2f', p_retailprice), ',.', '.,') || ' envio $ 9.999',
      'U$S 5 y $ ' || translate(printf('%,.2f', p_retailprice), ',.', '.,'), 'Precio: UYU ' || printf('%d', (p_partkey % 900)), 'sin precio U$45']) AS x FROM part)
    SELECT p_partkey, kind, CASE kind WHEN 0 THEN price WHEN 1 THEN price WHEN 2 THEN CASE WHEN p_partkey % 900 >= 100 THEN p_partkey % 900 END END AS price,
      CASE kind WHEN 0 THEN 'USD' WHEN 1 THEN 'UYU' WHEN 2 THEN CASE WHEN p_partkey % 900 >= 100 THEN 'UYU' END END AS currency,
      CASE kind WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN CASE WHEN p_partkey % 900 >= 100 THEN 0.9 END END::DOUBLE AS confidence FROM t""")
def price_direct(spark, sf):
    uy = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    kinds = F.array(
        F.concat(F.lit("Oferta "), F.col("p_name"), F.lit(" U$S "), uy, F.lit(" envio $ 9.999")),
        F.concat(F.lit("U$S 5 y $ "), uy),
        F.concat(F.lit("Precio: UYU "), (F.col("p_partkey") % 900).cast("string")),
        F.lit("sin precio U$45"),
    )
    rows = table(spark, sf, "part", spread=True).select("p_partkey", F.posexplode(kinds).alias("kind", "x"))
    return rows.withColumn("r", prices.direct_price(F.col("x"))).select(
        "p_partkey", "kind", "r.price", "r.currency", "r.confidence"
    )


def _direct_sql(source: str, key: str, column: str) -> str:
    """First price of each text by the patterns in order; a sign before a dollar mark is read as a letter left of it."""
    table = [(p.replace("(?<![US])", "(?:^|[^US])"), c, floor) for p, c, floor, _, _ in rules.DIRECT_PRICE_COMPAT]
    raw = ", ".join(f"regexp_extract({column}, '{p}', 1)" for p, _, _ in table)
    return f"""r AS (SELECT {key}, unnest(range({len(table)})) AS k, unnest([{raw}]) AS t, unnest({[c for _, c, _ in table]}) AS currency, unnest({[f for _, _, f in table]}) AS least FROM {source}),
    p AS (SELECT {key}, k, currency, least, {_PARSED} AS price FROM r),
    first AS (SELECT {key}, min_by(price, k) AS price, min_by(currency, k) AS currency FROM p WHERE price >= least GROUP BY {key})"""


@query("price_in_documents", f"WITH {_direct_sql('documents', 'doc_id', 'text')} SELECT doc_id, price, currency FROM documents LEFT JOIN first USING (doc_id)")
def price_in_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", prices.direct_price(F.col("text")).alias("r")).select("doc_id", "r.price", "r.currency")


@query("price_in_listed_documents", f"""WITH l AS (SELECT doc_id, text || ' Precio final: U$S ' || (doc_id % 900 + 50) || ',50 o $ ' || doc_id || '.100' AS x FROM documents),
    {_direct_sql('l', 'doc_id', 'x')} SELECT doc_id, price, currency FROM documents LEFT JOIN first USING (doc_id)""")
def price_in_listed_documents(spark, sf):
    """Every document with a price line behind its whole text, whatever else the text says of money."""
    body = F.concat("text", F.lit(" Precio final: U$S "), (F.col("doc_id") % 900 + 50).cast("string"), F.lit(",50 o $ "), F.col("doc_id").cast("string"), F.lit(".100"))
    return table(spark, sf, "documents").select("doc_id", prices.direct_price(body).alias("r")).select("doc_id", "r.price", "r.currency")


@query("currency_detect", f"""WITH {_TEXTS} SELECT p_partkey, kind, CASE WHEN regexp_matches(upper(t), 'U\\$S|US\\$|USD|U\\$\\$|DOLARES|DÓLARES|DOLLARS') THEN 'USD'
    WHEN regexp_matches(upper(t), 'UYU|UY\\$|PESOS|\\$') THEN 'UYU' END AS currency FROM texts""")
def currency_detect(spark, sf):
    return price_texts(spark, sf).select("p_partkey", "kind", prices.detect_currency(F.col("t")).alias("currency"))


_CODES = ["pesos", "US$", "eur", "clp", " u$s ", "", "Dolares", "$"]


@query("currency_normalize", "SELECT o_orderkey, (['UYU', 'USD', 'EUR', 'CLP', 'USD', NULL, 'USD', 'UYU'])[1 + o_orderkey % 8] AS currency FROM orders")
def currency_normalize(spark, sf):
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf, "orders", spread=True).select("o_orderkey", prices.normalize_currency(code).alias("currency"))


@query("currency_correct", "SELECT o_orderkey, (['USD', 'UYU', 'EUR'])[1 + o_orderkey % 3] AS currency FROM orders")
def currency_correct(spark, sf):
    shown = F.element_at(F.array(F.lit("U$S 10"), F.lit("UY$ 10"), F.lit("10")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders", spread=True).select("o_orderkey", prices.correct_currency(F.lit("EUR"), shown).alias("currency"))


@query("price_coerce", "SELECT o_orderkey, round(o_totalprice, 2) AS from_number, round(o_totalprice, 2) AS from_text, NULL::DOUBLE AS from_word FROM orders")
def price_coerce(spark, sf):
    shown = F.concat(F.lit("$ "), F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    return table(spark, sf, "orders", spread=True).select(
        "o_orderkey",
        F.round(prices.coerce_price(F.col("o_totalprice").cast("string")), 2).alias("from_number"),
        F.round(prices.coerce_price(shown), 2).alias("from_text"),
        prices.coerce_price(F.lit("consultar")).alias("from_word"),
    )


@query("price_sanity", """SELECT event_id, CASE WHEN round(value * 20) < 5 THEN 'too_low' WHEN round(value * 20) > 5000 AND event_type = 'view' THEN 'model_number' END AS reject_reason FROM events""")
def price_sanity(spark, sf):
    currency = F.when(F.col("event_type") == "view", "USD").otherwise("UYU")
    return table(spark, sf, "events").select(
        "event_id", prices.machine_price_reject(F.round(F.col("value") * 20), currency).alias("reject_reason")
    )


def answer_rows(spark, sf):
    """Outside answers per order: good, not found, no price, no number, out of range, broken."""
    price = F.format_string("%.2f", F.col("o_totalprice"))
    kinds = F.array(
        F.concat(F.lit('{"found": true, "price": '), price, F.lit(', "currency": "USD", "original_text": "U$S 10", "confidence": 0.7}')),
        F.lit('{"found": false, "price": 5}'),
        F.lit('{"found": true, "price": null}'),
        F.lit('{"found": true, "price": "gratis"}'),
        F.concat(F.lit('{"found": true, "price": "'), price, F.lit('"}')),
        F.lit('{"found": true, "price": 5000000}'),
        F.lit('{"found": tru'),
    )
    return table(spark, sf, "orders", spread=True).select("o_orderkey", F.posexplode(kinds).alias("kind", "raw_text"))


@query("price_validate", """SELECT o_orderkey, kind, CASE WHEN kind IN (0, 4) THEN round(o_totalprice, 2) END AS price, kind IN (0, 4) AS success,
      CASE kind WHEN 0 THEN 'USD' WHEN 4 THEN 'UYU' END AS currency, CASE kind WHEN 0 THEN 0.7 WHEN 4 THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence,
      (['', 'No price found in content', 'Price value missing from response', 'Invalid price value', '', 'Price 5000000.0 outside reasonable range', 'Invalid JSON response'])[kind + 1] AS error
    FROM orders, (SELECT unnest(range(7)) AS kind)""")
def price_validate(spark, sf):
    rows = answer_rows(spark, sf).withColumn("r", prices.response_price(F.col("raw_text")))
    return rows.select(
        "o_orderkey", "kind", F.round("r.price", 2).alias("price"), "r.success", "r.currency", "r.confidence",
        F.coalesce("r.error", F.lit("")).alias("error"),
    )


@query("price_reparse", """SELECT o_orderkey, CASE WHEN kind = 0 THEN 10.0 ELSE round(o_totalprice, 2) END AS price, CASE WHEN kind = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence,
      CASE WHEN kind = 0 THEN 'USD' ELSE 'UYU' END AS currency, kind FROM orders, (SELECT unnest([0, 4]) AS kind) WHERE kind = 4 OR round(o_totalprice, 2) <> 10""")
def price_reparse(spark, sf):
    rows = answer_rows(spark, sf).filter("kind IN (0, 4)").withColumn("p", prices.reparsed(prices.response_price(F.col("raw_text"))))
    return rows.select("o_orderkey", "kind", F.round("p.price", 2).alias("price"), "p.confidence", "p.currency")


@query("price_catalogue", """SELECT o_orderkey, o_custkey % 2 = 0 AS single, pos AS product_pos, 'item ' || pos AS product_name, CASE pos WHEN 0 THEN round(o_totalprice, 2) ELSE 1250.0 END AS price,
      CASE pos WHEN 0 THEN 'UYU' ELSE 'USD' END AS currency FROM orders, (SELECT unnest([0, 1]) AS pos) WHERE o_custkey % 2 = 1 OR pos = 0""")
def price_catalogue(spark, sf):
    raw = F.concat(
        F.lit('{"products": [{"product_name": "item 0", "price": '), F.format_string("%.2f", F.col("o_totalprice")),
        F.lit('}, {"product_name": "item 1", "price": 1.25, "currency": "UYU", "original_text": "U$S 1.250"}]}'),
    )
    rows = table(spark, sf, "orders", spread=True).select("o_orderkey", raw.alias("raw_text"), (F.col("o_custkey") % 2 == 0).alias("single"))
    return pricing.catalogue_offers(rows, "single").select(
        "o_orderkey", "single", "product_pos", "product_name", F.round("price_extraction.price", 2).alias("price"), "price_extraction.currency"
    )


_LD = """ld AS (SELECT p_partkey, p_retailprice AS price, unnest(range(7)) AS kind FROM part)"""


def structured_rows(spark, sf):
    """JSON-LD blocks per part: object, list, low price, nested, zero, text zero, and a block before the product."""
    price = F.format_string("%.2f", F.col("p_retailprice"))
    wrap = lambda *parts: F.concat(F.lit('{"@type": "Product", "offers": '), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("}"))
    kinds = F.array(
        F.array(wrap('{"price": "', price, '", "priceCurrency": "USD"}')),
        F.array(wrap('[{"price": ', price, '}, {"price": 1}]')),
        F.array(wrap('{"lowPrice": ', price, ', "price": 1}')),
        F.array(wrap('{"lowPrice": 0, "priceCurrency": "EUR", "offers": [{"price": ', price, "}]}")),
        F.array(wrap('{"price": 0}')),
        F.array(wrap('{"lowPrice": "0", "price": ', price, "}")),
        F.array(F.lit('{"@type": "BreadcrumbList"}'), F.lit("{bad"), wrap('{"price": "gratis"}'), wrap('{"price": ', price, "}")),
    )
    return table(spark, sf, "part", spread=True).select("p_partkey", F.posexplode(kinds).alias("kind", "docs"))


@query("price_structured", f"""WITH {_LD} SELECT p_partkey, kind, CASE WHEN kind NOT IN (4, 5) THEN price END AS price,
      CASE kind WHEN 0 THEN 'USD' WHEN 3 THEN 'EUR' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'UYU' END AS currency FROM ld""")
def price_structured(spark, sf):
    rows = structured_rows(spark, sf).withColumn("r", prices.structured_price(F.col("docs")))
    return rows.select("p_partkey", "kind", "r.price", "r.currency")


@query("price_meta", "SELECT 'https://shop.example.com.uy/producto/' || p_partkey AS url, round(p_retailprice, 2) AS price, 'USD' AS currency FROM part")
def price_meta(spark, sf):
    fields = page_ops.extract_fields(rich_pages(spark, sf), fields=["meta_tags"])
    return fields.withColumn("r", prices.meta_price(F.col("meta_tags"))).select("url", F.round("r.price", 2).alias("price"), "r.currency")


def cascade_inputs(spark, sf):
    """One candidate per part; its content decides the price source."""
    part = table(spark, sf, "part", spread=True).withColumn("url", F.concat(F.lit("https://shop.example.com.uy/p/"), F.col("p_partkey").cast("string")))
    price = F.format_string("%.2f", F.col("p_retailprice"))
    kind = F.col("p_partkey") % 16
    candidates = part.select(
        F.lit(1).alias("query_id"), "url", F.col("p_partkey").alias("pos"), F.when(kind == 7, "CATEGORY").otherwise("PRODUCT").alias("page_type"),
        F.col("p_name").alias("identified_product_name"),
    )
    long = F.concat(F.lit("Detalle del producto y condiciones de entrega en la tienda: "), F.col("p_name"))
    shown = F.concat(F.lit(" $ "), F.translate(F.format_number("p_retailprice", 2), ",.", ".,"))
    content = part.filter(~kind.isin(1, 9, 13)).select(
        "url",
        F.when(kind.isin(2, 8, 10, 11), "corto").when(kind == 12, F.concat(F.lit("corto"), shown))
        .when(kind == 5, F.concat(long, shown)).otherwise(long).alias("text"),
        F.when(kind.isin(4, 8), F.create_map(F.lit("product:price:amount"), price)).alias("meta_tags"),
        F.when(kind == 3, F.array(F.concat(F.lit('{"@type": "Product", "offers": {"price": '), price, F.lit("}}")))).alias("structured_data"),
    )
    cached = part.filter(kind == 0).select(
        "url", prices.result(F.col("p_retailprice"), F.lit("USD"), F.lit("x"), F.lit(0.9)).alias("price_extraction")
    )
    found = lambda p: F.concat(F.lit('{"found": true, "price": '), p, F.lit(', "confidence": 0.5}'))
    # 8: meta price and another answer; 9: no page; 10: short page; 11: out of range; 13: no page, no price; 14: catalogue; 15: bad
    raw = (
        F.when((kind == 6) & (F.col("p_size") > 25), found(price)).when(kind == 8, found(F.lit("7"))).when(kind.isin(9, 10), found(price))
        .when(kind == 11, found(F.lit("2"))).when(kind == 13, F.lit('{"found": false}'))
        .when(kind == 14, F.concat(F.lit('{"products": [{"product_name": "uno", "price": '), price, F.lit('}, {"product_name": "dos", "price": 1}]}')))
        .when(kind == 15, found(F.lit("25000000")))
    )
    answers = part.select("url", raw.alias("raw_text")).filter("raw_text IS NOT NULL")
    return candidates, content, cached, answers


@query("price_cascade", """SELECT 'https://shop.example.com.uy/p/' || p_partkey AS url,
      (['cached', 'no_content', 'insufficient', 'structured', 'meta', 'text', CASE WHEN p_size > 25 THEN 'response' ELSE 'unresolved' END, NULL,
        'meta', 'response', 'response', 'insufficient', 'text', 'no_content', 'response', 'response'])[k + 1] AS source,
      CASE WHEN k IN (0, 3, 4, 5, 8, 9, 10, 12, 14) OR (k = 6 AND p_size > 25) THEN round(p_retailprice, 2) END AS price,
      k IN (1, 2, 6, 9, 10, 11, 13, 15) AS needs_second_source,
      CASE WHEN k IN (1, 13) THEN 'Failed to retrieve page content from batch' WHEN k IN (2, 11) THEN 'Insufficient page content (5 chars)'
        WHEN k = 6 AND p_size <= 25 THEN 'No price found in content' WHEN k = 15 THEN 'Price 25000000.0 outside reasonable range' END AS error,
      CASE WHEN k = 14 THEN 'uno' ELSE p_name END AS product_name
    FROM (SELECT *, p_partkey % 16 AS k FROM part) WHERE k <> 7""")
def price_cascade(spark, sf):
    candidates, content, cached, answers = cascade_inputs(spark, sf)
    priced = pricing.extract_prices(candidates, content, cached, answers)
    return priced.select(
        "url", "source", F.round("price_extraction.price", 2).alias("price"), "needs_second_source", "price_extraction.error", "product_name"
    )


@query("product_pages", "SELECT 'https://shop.example.com.uy/p/' || p_partkey AS url FROM part WHERE p_partkey % 16 <> 7")
def product_pages(spark, sf):
    return pricing.product_pages(cascade_inputs(spark, sf)[0]).select("url")


# -- offers ----------------------------------------------------------------------------------
def shop_offers(spark, sf):
    """Line items as offers: the shop is the search, the part is the product page."""
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100
    ok = F.col("l_returnflag") != "R"
    good = prices.result(price, F.when(F.col("l_linestatus") == "O", "USD").otherwise("UYU"), F.lit("x"), F.round(1 - F.col("l_discount"), 2))
    return (
        table(spark, sf, "lineitem", spread=True)
        .join(table(spark, sf, "part", spread=True).select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
        .select(
            F.col("l_suppkey").alias("query_id"),
            F.concat(F.lit("https://shop.example.com/p/"), F.col("l_partkey").cast("string")).alias("url"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
            F.col("p_name").alias("product_name"),
            F.when(ok, good).otherwise(prices.failure(F.lit("No price found in content"))).alias("price_extraction"),
        )
    )


_OFFERS = """o AS (SELECT l_suppkey AS query_id, 'https://shop.example.com/p/' || l_partkey AS url, l_orderkey * 8 + l_linenumber AS pos, p_name AS product_name,
      CASE WHEN l_returnflag <> 'R' THEN floor(l_extendedprice * 100 / l_quantity) / 100 END AS price, l_returnflag <> 'R' AS success FROM lineitem JOIN part ON p_partkey = l_partkey),
    f AS (SELECT * FROM o WHERE success QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY pos) = 1)"""


@query("offers_first_per_url", f"WITH {_OFFERS} SELECT query_id, url, pos, price FROM f")
def offers_first_per_url(spark, sf):
    return offer_ops.first_per_url(shop_offers(spark, sf)).select("query_id", "url", "pos", F.col("price_extraction.price").alias("price"))


@query("offer_names", """SELECT p_partkey, array_to_string([t FOR t IN regexp_split_to_array(lower('NUEVO ' || p_name || ' (Pack) promoción ' || p_type), '[^a-z0-9]+')
    IF length(t) > 2 AND t NOT IN ('nuevo', 'oferta', 'original', 'promo', 'promocion', 'envio', 'gratis', 'pack', 'combo')], ' ') AS name FROM part""")
def offer_names(spark, sf):
    shown = F.concat(F.lit("NUEVO "), F.col("p_name"), F.lit(" (Pack) promoción "), F.col("p_type"))
    return table(spark, sf, "part", spread=True).select("p_partkey", text.product_name_key(shown).alias("name"))


@query("offers_dedupe", f"""WITH o AS (SELECT l_suppkey AS query_id, 'https://shop.example.com/p/' || l_partkey AS url, l_orderkey * 8 + l_linenumber AS pos, substr(md5(p_name), 1, 12) AS base,
      floor(l_extendedprice * 100 / l_quantity) / 100 AS price, CASE WHEN l_linestatus = 'O' THEN 'USD' ELSE 'UYU' END AS currency, round(1 - l_discount, 2) AS confidence
      FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY pos) = 1),
    c AS (SELECT query_id, base, min(pos) AS leader, list_reduce(list({{'url': url, 'price': price, 'currency': currency, 'confidence': confidence}} ORDER BY pos, url),
      lambda a, b: CASE WHEN (a.currency = b.currency AND b.price < a.price) OR (a.currency <> b.currency AND b.confidence > a.confidence) THEN b ELSE a END) AS w FROM o GROUP BY query_id, base)
    SELECT query_id, w.url AS url, leader, w.price AS price FROM c""")
def offers_dedupe(spark, sf):
    """Names are far-apart bases, one per part name, half of them with a changed letter: clusters are known."""
    base = F.left(F.md5(F.col("product_name")), F.lit(12))
    spelled = F.when(F.col("pos") % 2 == 0, base).otherwise(F.concat(F.lit("x"), F.substring(base, 2, 11)))
    first = offer_ops.first_per_url(shop_offers(spark, sf).withColumn("product_name", spelled))
    return offer_ops.dedupe_names(first).select("query_id", "url", "leader", F.col("price_extraction.price").alias("price"))


@query("offers_ranked", f"WITH {_OFFERS} SELECT query_id, url, pos, price, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(price, 'inf'::DOUBLE), pos, url) AS rank FROM o")
def offers_ranked(spark, sf):
    return offer_ops.rank_offers(shop_offers(spark, sf)).select("query_id", "url", "pos", F.col("price_extraction.price").alias("price"), "rank")


@query("offers_ranked_base", f"""WITH o AS (SELECT l_suppkey AS query_id, l_orderkey * 8 + l_linenumber AS pos, 'https://shop.example.com/p/' || l_partkey AS url,
      CASE WHEN l_returnflag <> 'R' THEN floor(l_extendedprice * 100 / l_quantity) / 100 * CASE WHEN l_linestatus = 'O' THEN 40 ELSE 1 END END AS price_base FROM lineitem)
    SELECT query_id, pos, round(price_base, 2) AS price_base, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(price_base, 'inf'::DOUBLE), pos, url) AS rank FROM o""")
def offers_ranked_base(spark, sf):
    rates = table(spark, sf, "region").select(
        F.when(F.col("r_regionkey") == 0, "USD").when(F.col("r_regionkey") == 1, "UYU").alias("currency"),
        F.when(F.col("r_regionkey") == 0, 40.0).otherwise(1.0).alias("rate"),
    ).filter(F.col("currency").isNotNull())
    return offer_ops.rank_offers(shop_offers(spark, sf), rates).select("query_id", "pos", F.round("price_base", 2).alias("price_base"), "rank")


@query("offers_batch", f"""WITH {_OFFERS}, r AS (SELECT unnest([s_suppkey, s_suppkey + 1000000]) AS query_id FROM supplier)
    SELECT query_id, count(url) AS offers, min(price) AS best_price, count(url) > 0 AS success FROM r LEFT JOIN f USING (query_id) GROUP BY query_id""")
def offers_batch(spark, sf):
    asked = table(spark, sf, "supplier").select(F.explode(F.array("s_suppkey", F.col("s_suppkey") + 1000000)).alias("query_id"))
    return offer_ops.search_summaries(asked, offer_ops.first_per_url(shop_offers(spark, sf)))


# -- recovered answers -----------------------------------------------------------------------
def raw_answers(spark, sf):
    """Query lists as returned: plain, fenced, commented, in a sentence, cut off, inside a string, beyond repair."""
    name = F.col("p_name")
    good = F.concat(F.lit('{"queries": ["comprar '), name, F.lit('", "'), name, F.lit(' precio"]}'))
    kinds = F.array(
        good,
        F.concat(F.lit("Claro:\n```json\n"), good, F.lit("\n```\nlisto")),
        F.concat(F.lit("```\n"), F.replace(good, F.lit("}"), F.lit(', // fin\n "url": "https://x.uy",}')), F.lit("```")),
        F.concat(F.lit("Aqui: "), good, F.lit(" fin")),
        F.concat(F.lit('["comprar '), name, F.lit('", "'), name, F.lit(' precio", "otra')),
        F.to_json(F.struct(good.alias("s"))),
        F.concat(F.lit('queries = "comprar '), name, F.lit('"')),
        F.lit("nada"),
    )
    return table(spark, sf, "part", spread=True).select(F.posexplode(kinds).alias("kind", "raw_text"), "p_partkey").select(
        (F.col("p_partkey") * 8 + F.col("kind")).alias("id"), "kind",
        F.when(F.col("kind") == 5, F.regexp_extract("raw_text", r'(?s)^\{"s":(".*")\}$', 1)).otherwise(F.col("raw_text")).alias("raw_text"),
    )


@query("answers_queries", """SELECT p_partkey * 8 + kind AS id, (['direct', 'fence', 'comments', 'balanced', 'closed', 'direct', 'pattern', 'failed'])[kind + 1] AS method,
      CASE WHEN kind IN (0, 1, 2, 3, 5) THEN 'comprar ' || p_name || '|' || p_name || ' precio' WHEN kind IN (4, 6) THEN 'comprar ' || p_name ELSE '' END AS queries
    FROM part, (SELECT unnest(range(8)) AS kind)""")
def answers_queries(spark, sf):
    return responses.response_queries(raw_answers(spark, sf)).select("id", "method", F.array_join("queries", "|").alias("queries"))


@query("answers_report", """SELECT (['direct', 'fence', 'comments', 'balanced', 'closed', 'direct', 'pattern', 'failed'])[kind + 1] AS method, count(*) AS responses
    FROM part, (SELECT unnest(range(8)) AS kind) GROUP BY 1""")
def answers_report(spark, sf):
    return responses.recovery_report(responses.response_queries(raw_answers(spark, sf)))


@query("answers_fields", """SELECT p_partkey, kind, (['PRODUCT', 'CATEGORY... (truncated)', 'ERROR_LLM_NULL_PAGE_TYPE', 'ERROR_PARSING_JSON', 'PRODUCT'])[kind + 1] AS page_type,
      CASE WHEN kind IN (0, 4) THEN p_name END AS identified_product_name FROM part, (SELECT unnest(range(5)) AS kind)""")
def answers_fields(spark, sf):
    name = F.col("p_name")
    kinds = F.array(
        F.concat(F.lit('{"page_type": "PRODUCT", "identified_product_name": "'), name, F.lit('"}')),
        F.lit('"page_type": "CATEGORY'),
        F.lit('{"reasoning": "x"}'),
        F.lit("sin respuesta"),
        F.concat(F.lit('"page_type": "PRODUCT", "identified_product_name": "'), name, F.lit('", "reasoning": "cort')),
    )
    rows = table(spark, sf, "part", spread=True).select("p_partkey", F.posexplode(kinds).alias("kind", "raw_text"))
    return responses.response_fields(rows).select("p_partkey", "kind", "page_type", "identified_product_name")


@query("answers_indices", """SELECT l_orderkey AS id, l_linenumber AS index FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 OR l_linenumber IN (1, 3)""")
def answers_indices(spark, sf):
    items = table(spark, sf, "lineitem", spread=True).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("index"))
    raw = F.element_at(F.array(F.lit("???"), F.lit('{"product_url_indices": [1, 3, 99]}'), F.lit("[1, 3]")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    answers = table(spark, sf, "orders", spread=True).select(F.col("o_orderkey").alias("id"), raw.alias("raw_text"))
    return responses.chosen_indices(answers, items)
