"""Price and currency Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelake.functions import rules
from pricelake.functions.expr import let


def parse_price(text: Column, compat: bool = True) -> Column:
    """Number in a price text with either decimal mark.

    ``compat`` keeps two known quirks: with both marks present dots are always thousands, and two
    dots alone give null. Without it the last mark decides and repeated marks are thousands.
    """

    def value(bare: Column) -> Column:
        comma_decimal = F.translate(bare, ",.", ".")
        if compat:
            chosen = F.when(bare.rlike(r",.*\.|\..*,"), comma_decimal)
        else:
            chosen = (
                F.when(bare.rlike(r"\..*,"), comma_decimal)
                .when(bare.rlike(r",.*\."), F.translate(bare, ",", ""))
                .when(bare.rlike(r",.*,|\..*\."), F.translate(bare, ",.", ""))
            )
        return (
            chosen.when(bare.rlike(r"^[^,]*,[^,]{0,2}$"), F.translate(bare, ",", "."))
            .when(bare.rlike(r"^[^,]*,[^,]*$"), F.translate(bare, ",", ""))
            .when(bare.rlike(r"^[^.]*\.[^.]{3,}$"), F.translate(bare, ".", ""))
            .otherwise(bare)
            .try_cast("double")
        )

    return let(F.regexp_replace(text, r"(?U)[$€a-zA-Z\s]", ""), value)


def coerce_price(value: Column) -> Column:
    """Plain float first, price text second."""
    plain = F.when(value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), value.try_cast("double"))
    return F.coalesce(plain, parse_price(value))


def detect_currency(text: Column) -> Column:
    def test(up: Column) -> Column:
        usd = reduce(lambda a, b: a | b, [up.contains(m) for m in rules.USD_MARKERS])
        uyu = reduce(lambda a, b: a | b, [up.contains(m) for m in [*rules.UYU_MARKERS, "$"]])
        return F.when(usd, "USD").when(uyu, "UYU")

    return let(F.upper(text), test)


def normalize_currency(code: Column) -> Column:
    up = F.trim(F.upper(code))
    table = F.create_map(*[F.lit(x) for pair in rules.CURRENCY_ALIASES.items() for x in pair])
    return F.when(code != "", F.coalesce(F.try_element_at(table, up), up))


def correct_currency(stated: Column, original_text: Column) -> Column:
    return F.coalesce(detect_currency(original_text), stated)


RESULT = "struct<success:boolean,price:double,currency:string,original_text:string,confidence:double,error:string>"


def result(price: Column, currency: Column, original_text: Column, confidence: Column) -> Column:
    """Successful price result; null when there is no price."""
    full = F.struct(
        F.lit(True).alias("success"),
        price.alias("price"),
        currency.alias("currency"),
        original_text.alias("original_text"),
        confidence.alias("confidence"),
        F.lit(None).cast("string").alias("error"),
    )
    return F.when(price.isNotNull(), full.cast(RESULT))


def failure(error: Column) -> Column:
    return F.struct(
        F.lit(False).alias("success"),
        F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("string").alias("currency"),
        F.lit(None).cast("string").alias("original_text"),
        F.lit(0.0).alias("confidence"),
        error.alias("error"),
    ).cast(RESULT)


def direct_price(text: Column, compat: bool = True) -> Column:
    """First price in running text: dollar marks first, then pesos, each with its floor.

    Only the first match of each pattern counts; the whole text is read.
    """
    table = rules.DIRECT_PRICE_COMPAT if compat else rules.DIRECT_PRICE_PLAIN
    found = F.array(
        *[
            F.struct(
                F.regexp_extract(text, pattern, 1).alias("raw"),
                F.lit(currency).alias("currency"),
                F.lit(floor).alias("floor"),
                F.lit(confidence).alias("confidence"),
                F.lit(label).alias("label"),
            )
            for pattern, currency, floor, confidence, label in table
        ]
    )
    priced = F.transform(found, lambda t: t.withField("price", parse_price(t["raw"], compat)))
    first = F.try_element_at(F.filter(priced, lambda t: t["price"] >= t["floor"]), F.lit(1))
    return let(
        first,
        lambda t: result(t["price"], t["currency"], F.concat(t["label"], t["raw"]), t["confidence"]),
    )


def machine_price_reject(price: Column, currency: Column) -> Column:
    """Reason to refuse a machine-read price, or null."""
    return F.when(price < 5, "too_low").when(
        (price > 5000) & (price == F.floor(price)) & (F.coalesce(currency, F.lit("UYU")) == "USD"),
        "model_number",
    )


# -- machine-readable prices -----------------------------------------------------------------
def _truthy(value: Column) -> Column:
    """Zero, empty text, false and null count as missing; the text "0" does not."""

    def test(kind: Column) -> Column:
        return F.coalesce(
            value.isNotNull()
            & ~kind.isin("VOID", "NULL")
            & F.when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
            .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
            .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(True))
            .otherwise(F.try_variant_get(value, "$", "double") != 0),
            F.lit(False),
        )

    return let(F.schema_of_variant(value), test)


def _product_offer(doc: Column) -> Column:
    """(price, currency, raw) of one JSON-LD document, null unless it is a product with a price above 0."""
    part = lambda path: F.try_variant_get(doc, path, "variant")
    text = lambda path: F.try_variant_get(doc, path, "string")
    kind = lambda path: F.coalesce(F.schema_of_variant(part(path)), F.lit(""))
    low, own = part("$.offers.lowPrice"), part("$.offers.price")
    nested_first = kind("$.offers.offers").startswith("ARRAY") & kind("$.offers.offers[0]").startswith("OBJECT")
    nested = ~(_truthy(low) | _truthy(own)) & nested_first
    is_map, is_list = kind("$.offers").startswith("OBJECT"), kind("$.offers").startswith("ARRAY")
    chosen = (
        F.when(is_map & nested, part("$.offers.offers[0].price"))
        .when(is_map & _truthy(low), low)
        .when(is_map, own)
        .when(is_list, part("$.offers[0].price"))
    )
    currency = (
        F.when(is_map & nested, F.coalesce(text("$.offers.offers[0].priceCurrency"), text("$.offers.priceCurrency")))
        .when(is_map, text("$.offers.priceCurrency"))
        .when(is_list, text("$.offers[0].priceCurrency"))
    )
    offer = lambda raw: F.struct(
        raw.try_cast("double").alias("price"), F.coalesce(currency, F.lit("UYU")).alias("currency"), raw.alias("raw")
    )
    found = let(F.try_variant_get(chosen, "$", "string"), offer)
    good = lambda o: F.when((o["price"] > 0) & ~F.isnan(o["price"]), o)
    return F.when(text('$["@type"]') == "Product", let(found, good))


def structured_price(documents: Column) -> Column:
    """First JSON-LD product with a price above 0. ``documents`` holds the blocks as text."""
    parsed = F.transform(documents, lambda d: F.try_parse_json(d))
    offers = F.filter(F.transform(parsed, _product_offer), lambda o: o.isNotNull())
    return let(
        F.try_element_at(offers, F.lit(1)),
        lambda o: result(o["price"], o["currency"], F.concat_ws(" ", o["currency"], o["raw"]), F.lit(1.0)),
    )


def meta_price(meta_tags: Column) -> Column:
    raw = F.try_element_at(meta_tags, F.lit("product:price:amount"))
    currency = F.coalesce(F.try_element_at(meta_tags, F.lit("product:price:currency")), F.lit("UYU"))
    value = F.trim(raw).try_cast("double")
    return F.when(
        (value > 0) & ~F.isnan(value), result(value, currency, F.concat_ws(" ", currency, raw), F.lit(1.0))
    )


def shown_number(value: Column) -> Column:
    """A float as error texts print it: plain digits below 1e16, then with a signed exponent."""
    raw = value.cast("string")
    plain = F.regexp_replace(raw.try_cast("decimal(38,16)").cast("string"), r"^(-?\d+\.(?:\d*[1-9]|0))0*$", "$1")
    small = F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), r"E-(\d)$", "e-0$1")
    short = F.regexp_replace(F.regexp_replace(small, r"E(\d)", "e+$1"), "E-", "e-")
    return F.when((F.abs(value) >= 1e-4) & (F.abs(value) < 1e16) | (value == 0), plain).otherwise(short)


_CATALOGUE = "array<struct<product_name: string, price: double, currency: string, original_text: string, confidence: double>>"


def catalogue_items(answer: Column) -> Column:
    """Products of an answer ``{"products": [...]}``, else null."""
    return F.from_json(F.get_json_object(answer, "$.products"), _CATALOGUE)


def catalogue_price(item: Column, compat: bool = True) -> Column:
    """Price of one catalogue product, with defaults for what it leaves out."""
    return reparsed(
        result(
            F.coalesce(item["price"], F.lit(0.0)), F.coalesce(item["currency"], F.lit("UYU")),
            F.coalesce(item["original_text"], F.lit("")), F.coalesce(item["confidence"], F.lit(0.8)),
        ),
        compat,
    )


def response_price(answer: Column) -> Column:
    """Checked price of an outside answer given as JSON text: found flag, value, range, defaults."""

    def checked(doc: Column) -> Column:
        field = lambda name, kind: F.try_variant_get(doc, f"$.{name}", kind)

        def priced(p: Column) -> Column:
            raw, value = p["raw"], p["value"]
            return (
                F.when(raw.isNull(), failure(F.lit("Price value missing from response")))
                .when(value.isNull(), failure(F.lit("Invalid price value")))
                .when(
                    (value <= 0) | (value > rules.MAX_RESPONSE_PRICE),
                    failure(F.concat(F.lit("Price "), shown_number(value), F.lit(" outside reasonable range"))),
                )
                .otherwise(
                    result(
                        value,
                        F.coalesce(field("currency", "string"), F.lit("UYU")),
                        field("original_text", "string"),
                        F.coalesce(field("confidence", "double"), F.lit(0.8)),
                    )
                )
            )

        # a field is read once, and only where the ones before it leave the answer open
        stated = let(field("price", "string"), lambda raw: F.struct(raw.alias("raw"), raw.try_cast("double").alias("value")))
        return (
            F.when(doc.isNull(), failure(F.lit("Invalid JSON response")))
            .when(~let(field("found", "variant"), _truthy), failure(F.lit("No price found in content")))
            .otherwise(let(stated, priced))
        )

    return let(F.try_parse_json(answer), checked)


def reparsed(priced: Column, compat: bool = True) -> Column:
    """Override a stated price by the one its own text gives, then correct the currency."""

    def fix(p: Column) -> Column:
        own = parse_price(p["original_text"], compat)
        return let(
            own,
            lambda v: F.when(
                p["success"],
                F.struct(
                    p["success"].alias("success"),
                    F.coalesce(v, p["price"]).alias("price"),
                    correct_currency(p["currency"], p["original_text"]).alias("currency"),
                    p["original_text"].alias("original_text"),
                    F.when(v.isNotNull() & (v != p["price"]), 1.0).otherwise(p["confidence"]).alias("confidence"),
                    p["error"].alias("error"),
                ).cast(RESULT),
            ).otherwise(p),
        )

    return let(priced, fix)
