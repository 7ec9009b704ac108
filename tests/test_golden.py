"""Worked cases with expected values found by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricelake.functions import jsonfix, prices, urls
from pricelake.operators import jobs, relevance, responses, textsearch, urltable
from pricelake.functions.html import page_fields


def apply(spark, rows, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_sanitize(spark):
    cases = {
        "https://store.com.uy/product › category": "https://store.com.uy/product",
        "https://tata.com.uy.Visit": "https://tata.com.uy",
        "ftp://a.com/x": None,
        "https://localhost/x": None,
        "https://a.com/xhttps://b.com/y": "https://a.com/x",
        "https://a.com/x http://b.com/y": "https://a.com/x",
        "https://a.com/good/bad seg": "https://a.com/good",
        "https://tienda.com/café...": "https://tienda.com/café",
        "https://a..com/x": None,
        "https://example.com:8080/p": "https://example.com:8080/p",
        "https://abc.verylongtoplevel123/x": "https://abc.verylongtoplevel123/x",
        "https://averylonglabelhere.verylongtoplevel/x": None,
        "": None,
    }
    assert apply(spark, list(cases), urls.sanitize) == list(cases.values())
    df = spark.createDataFrame([(c,) for c in cases], "u string")
    both = urls.with_sanitized(df, "u", "a").withColumn("b", urls.sanitize(F.col("u")))
    assert both.filter("NOT (a <=> b)").count() == 0


def test_normalize(spark):
    cases = {
        "HTTPS://WWW.Example.COM/Page/?utm_source=google": "https://example.com/page",
        "https://a.com/x/?ref=1&b=2#f": "https://a.com/x?b=2",
        "https://a.com/?a=1&&gclid=3&b": "https://a.com?a=1&&b",
        "https://a.com/p;v=1?referer=2": "https://a.com/p",
        " https://a.com/x ": "https://a.com/x",
    }
    assert apply(spark, list(cases), urls.normalize) == list(cases.values())
    assert apply(spark, ["https://www.a.com/x/?b=2"], lambda c: urls.normalize(c, drop_query=True)) == ["https://a.com/x"]


def test_repeated_segments(spark):
    cases = {
        "https://loi.com.uy/electrodomesticos/orden-y-limpieza/electrodomesticos/orden-y-limpieza/planchas": "https://loi.com.uy/electrodomesticos/orden-y-limpieza/planchas",
        "https://loi.com.uy/electrodomesticos/orden-y-limpieza/electrodomesticos": "https://loi.com.uy/electrodomesticos/orden-y-limpieza",
        "https://a.com/x//y": "https://a.com/x//y",
        "HTTPS://a.com/x/x/?q=1#z": "https://a.com/x/?q=1#z",
        "https://a.com/x/x;v=1?": "https://a.com/x;v=1",
    }
    assert apply(spark, list(cases), urls.drop_repeated_segments) == list(cases.values())


def test_product_and_query(spark):
    assert apply(spark, ["https://store.com.uy/producto/123", "https://store.com.uy/category/shoes"], urls.is_product_url) == [True, False]
    terms = F.array(F.lit("plancha"), F.lit("vapor"))
    rows = ["https://store.com/planchas/vapor", "https://store.com/aspiradoras", "https://store.com/planch/x"]
    assert apply(spark, rows, lambda c: urls.matches_query(c, terms)) == [True, False, True]


@pytest.mark.parametrize("ref, want", [
    ("/x", "https://a.com/x"), ("x", "https://a.com/d/x"), ("../y", "https://a.com/y"), ("./z/", "https://a.com/d/z/"),
    ("//b.com/q", "https://b.com/q"), ("?k=1", "https://a.com/d/p?k=1"), ("mailto:m@x", "mailto:m@x"), ("/a/../b", "https://a.com/b"),
    ("g;x=1/../y", "https://a.com/d/y"),
])
def test_resolve(spark, ref, want):
    got = spark.range(1).select(urls.resolve(F.lit("https://a.com/d/p?s=1"), F.lit(ref))).first()[0]
    assert got == want


def test_glob(spark):
    rows = ["https://a.com/cart/x", "https://a.com/b.pdf", "https://a.com/q", "https://a.com/x1"]
    test = lambda c: urls.exclude_glob(c, ["*/cart/*", "*.pdf", "*/x[0-9]", None, " "])
    assert apply(spark, rows, test) == [True, True, False, True]


def test_prices(spark):
    cases = {"$189": 189, "$13.000,00": 13000, "$1.250": 1250, "$45,50": 45.5, "UYU 220": 220, "U$S35,00": 35, "1,250.50": 1.2505, "1.234.567": None, "": None, "x": None}
    assert apply(spark, list(cases), prices.parse_price) == list(cases.values())
    free = {"1,250.50": 1250.5, "1.234.567": 1234567, "13.000,00": 13000, "1.250": 1250}
    assert apply(spark, list(free), lambda c: prices.parse_price(c, compat=False)) == list(free.values())
    direct = {
        "U$S 69": ("USD", 69, 0.95), "USD 31,50": ("USD", 31.5, 0.95), "$ 1.090,00": ("UYU", 1090, 0.90), "$670": ("UYU", 670, 0.90),
        "$45": None, "U$S 1299": ("USD", 129, 0.95), "U$S 5 y $ 2.000": ("UYU", 2000, 0.90),
    }
    got = apply(spark, list(direct), prices.direct_price)
    assert [g and (g.currency, g.price, g.confidence) for g in got] == list(direct.values())
    assert apply(spark, ["U$S 1299"], lambda c: prices.direct_price(c, compat=False))[0].price == 1299
    late = "x" * 4000 + " U$S 99"
    assert apply(spark, [late], prices.direct_price)[0].price == 99
    assert apply(spark, ["U$S39,00", "$189", "UY$ 5", "€ 5"], prices.detect_currency) == ["USD", "UYU", "UYU", None]
    assert apply(spark, ["pesos", "US$", "eur", "clp"], prices.normalize_currency) == ["UYU", "USD", "EUR", "CLP"]


def test_relevance(spark):
    row = ("plancha vapor", "https://loi.com.uy/planchas", "Plancha a vapor", "envio a Montevideo")
    df = spark.createDataFrame([row], "query string, url string, original_title string, original_snippet string")
    got = relevance.score_candidates(df).first()
    assert (round(got.relevance_score, 4), got.location_score, round(got.combined_score, 4)) == (0.7, 1.0, 0.9)


def test_keep_first(spark):
    df = spark.createDataFrame([(v, i) for i, v in enumerate("abacb")], "v string, pos int").repartition(3)
    assert [r.v for r in urltable.keep_first(df, ["v"]).orderBy("pos").collect()] == ["a", "b", "c"]


def test_json_repair(spark):
    assert apply(spark, ['```json\n{"key": "value"}\n```'], jsonfix.strip_fence) == ['{"key": "value"}']
    cases = {
        '{"items": ["a", "b"': '{"items": ["a", "b"]}',
        '["q1", "q2", "q3': '["q1"]',
        '{"a": 1}': '{"a": 1}',
        '["a", ': '["a"]',
    }
    assert apply(spark, list(cases), jsonfix.close_truncated) == list(cases.values())
    assert apply(spark, ['{"u": "https://a.com" // c\n}'], jsonfix.drop_comments) == ['{"u": "https://a.com" \n}']
    text = '{"queries": ["comprar laptop Uruguay", "laptop Montevideo"]}'
    assert apply(spark, [text], jsonfix.recover_queries) == [["comprar laptop Uruguay", "laptop Montevideo"]]
    df = spark.createDataFrame([(1, "x {\"a\": [1, 2]} y"), (2, '"a": "b'), (3, '{"a": 1}')], "id int, raw_text string")
    got = {r.id: r.method for r in responses.recover_json(df).collect()}
    assert got == {1: "balanced", 2: "error_parsing_json", 3: "direct"}


def test_halving_average(spark):
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate((4, 2, 6))], "stage string, n int, x double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("n") * 4000))
    got = {r.stage: r.average for r in jobs.average_durations(df, ["stage"], "ts", "x", "n").collect()}
    assert got == {"s": 4.0, None: 4.0}


def test_page_fields():
    html = (
        '<!DOCTYPE html><html><head><title> T </title><meta name="description" content="D"><meta property="og:x" content="1">'
        '<meta content="none"><script type="application/ld+json">{"a":1}</script><style>p{}</style></head>'
        "<body><h1> A <b>B</b></h1><h2>C</h2><article>old</article><main>m1 <p>m2</main>tail<img src=i.png alt=x>"
        '<a href="/q?x=1&amp;y=2">l</a><a name=n>no</a><!-- c --></body></html>'
    )
    got = page_fields("https://a.com/d/p", html)
    assert got["title"] == "T" and got["headers"] == {"h1": ["AB"], "h2": ["C"], "h3": []}
    assert got["meta_tags"] == {"description": "D", "og:x": "1"}
    assert got["main_content"] == "m1m2" and got["full_text"] == "TABColdm1m2taillno"
    assert got["images"] == [{"src": "i.png", "alt": "x", "title": ""}]
    assert got["links"] == ["https://a.com/q?x=1&y=2"] and got["json_ld"] == ['{"a":1}']


def test_cover_rank_three_terms(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], "a x b c y a".split())], "query_id int, terms array<string>, tokens array<string>")
    got = df.select(textsearch.cover_density_rank()).first()[0]
    # covers: a(1)..c(4) with one other word, b(3)..a(6) with one other word
    assert abs(got - (0.1 / 2 + 0.1 / 2)) < 1e-9
