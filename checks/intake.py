"""Checks: result intake, candidate filters, geography, typing, relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import urlsql as U
from checks.common import query, sql_in, sql_list, sql_stamp, table
from pricelake.functions import geo, rules, text, urls
from pricelake.operators import candidates as cand
from pricelake.operators import geography, pagetypes, relevance, serp, store
from pricelake.operators import pages as page_ops
from pricelake.plans.search import best_pages
from pricelake.session import cut_lineage


# -- searches and hits derived from the stored pages -----------------------------------------
def page_hits(spark, sf):
    """Every page is a hit of the search of its language; the search text is taken from its first page."""
    pages = table(spark, sf, "pages")
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)", 1)
    title = text.html_title(F.col("html"))
    ad = F.regexp_extract("html", r'(?s)<div class="ad">(.*?)</div>', 1)
    hits = pages.select(
        lang.alias("query_id"), F.col("page_id").alias("pos"), "url", title.alias("original_title"), ad.alias("original_snippet")
    )
    first = hits.groupBy("query_id").agg(F.min_by("original_title", "pos").alias("t"))
    words = F.array_join(text.relevance_tokens(F.col("t")), " ")
    return hits.join(first.select("query_id", words.alias("query")), "query_id")


_STOP = sql_in(rules.RELEVANCE_STOP_WORDS)


def _tokens(c: str) -> str:
    return f"[t FOR t IN regexp_split_to_array(lower({c}), '[^a-zA-Z0-9]+') IF length(t) > 2 AND t NOT IN {_STOP}]"


_HITS = f"""hits0 AS (SELECT regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS query_id, page_id AS pos, url,
      trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS original_title,
      regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS original_snippet FROM pages),
    qs AS (SELECT query_id, array_to_string({_tokens('min_by(original_title, pos)')}, ' ') AS query FROM hits0 GROUP BY query_id),
    hits AS (SELECT * FROM hits0 JOIN qs USING (query_id))"""

_SUFFIXES = "[array_to_string(string_split(h, '.')[i:], '.') FOR i IN range(1, len(string_split(h, '.')) + 1)]"


def _overlap(q: str, t: str) -> str:
    return f"(len(list_distinct(list_intersect({q}, {t}))) / greatest(1, len(list_distinct({q}))))"


_SCORED = f"""tok AS (SELECT *, {_tokens('query')} AS q, {_tokens('original_title')} AS t, {_tokens('original_snippet')} AS s FROM {{source}}),
    raw AS (SELECT *, least(1.0, CASE WHEN {U.matches_query('url', 'q')} THEN 0.4 ELSE 0 END + 0.3 * {_overlap('q', 't')} + 0.2 * {_overlap('q', 's')}
      + CASE WHEN query <> '' AND contains(lower(url), lower(query)) THEN 0.1 ELSE 0 END) AS rel,
      CASE WHEN regexp_matches(lower(url || ' ' || original_title || ' ' || original_snippet), 'montevideo|mvd') THEN 1.0 ELSE 0.0 END AS location_score FROM tok),
    scored AS (SELECT * EXCLUDE (q, t, s, rel), round(rel, 4) AS relevance_score, round(least(1.0, rel + 0.2 * location_score), 4) AS combined_score FROM raw)"""


@query("relevance_score", f"""WITH {_HITS}, {_SCORED.format(source='hits')}
    SELECT query_id, pos, url, relevance_score::DOUBLE AS relevance_score, location_score::DOUBLE AS location_score, combined_score::DOUBLE AS combined_score FROM scored""")
def relevance_score(spark, sf):
    return relevance.score_candidates(page_hits(spark, sf)).select(
        "query_id", "pos", "url", "relevance_score", "location_score", "combined_score"
    )


_EXCLUDED = "regexp_matches(lower({u}), '/(?:" + "|".join(rules.EXCLUDE_SEGMENTS) + ")/|" + rules.EXCLUDE_LISTING_PATTERN + "|\\.(?:" + "|".join(rules.EXCLUDE_EXTENSIONS) + ")$')"
_BLOCKED = "EXISTS (SELECT 1 FROM (SELECT unnest({d}) AS d) WHERE " + U.netloc("lower(url)") + " = d OR ends_with(" + U.netloc("lower(url)") + ", '.' || d))"
_CAPPED = f"""keyed AS (SELECT *, {U.normalized('url', True)} AS dk, {U.host('url')} AS host FROM {{source}}),
    firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY query_id, host, dk ORDER BY pos, url) = 1),
    capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY pos, url) AS host_rank FROM firsts QUALIFY host_rank <= {{cap}})"""
_GATE = """gated AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, pos, url) AS rank
      FROM (SELECT *, max(relevance_score >= 0.2) OVER (PARTITION BY query_id) AS any_ok FROM scored)
      WHERE (relevance_score >= 0.2) = any_ok QUALIFY rank <= 10)"""


@query("relevance_gate", f"""WITH {_HITS}, ok AS (SELECT * FROM hits WHERE NOT {_EXCLUDED.format(u='url')}),
    {_CAPPED.format(source='ok', cap=10)}, {_SCORED.format(source='capped')}, {_GATE}
    SELECT query_id, query, url, relevance_score::DOUBLE AS relevance_score, combined_score::DOUBLE AS combined_score, rank FROM gated""")
def relevance_gate(spark, sf):
    return best_pages(page_hits(spark, sf), per_host=10, top=10).select("query_id", "query", "url", "relevance_score", "combined_score", "rank")


@query("relevance_tokens", f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents")
def relevance_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.relevance_tokens(F.col("text")), " ").alias("tokens"))


@query("relevance_overlap", f"SELECT conv_id, turn, round({_overlap(_tokens('role || text'), _tokens('text'))}, 6) AS overlap FROM conversations")
def relevance_overlap(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", text.relevance_tokens(F.concat("role", "text")).alias("q"), text.relevance_tokens(F.col("text")).alias("t")
    )
    return rows.select("conv_id", "turn", F.round(text.overlap_ratio(F.col("q"), F.col("t")), 6).alias("overlap"))


# -- result intake ---------------------------------------------------------------------------
@query("search_fanout", """SELECT item_id AS query_id, engine, pos, head || replace(url_encode(text || ' UY'), '%20', '+') || tail AS search_url FROM benchmark, (VALUES
      ('duckduckgo', 0, 'https://html.duckduckgo.com/html/?q=', ''), ('startpage', 1, 'https://www.startpage.com/sp/search?q=', '&cat=web&language=english'),
      ('ecosia', 2, 'https://www.ecosia.org/search?q=', ''), ('qwant', 3, 'https://www.qwant.com/?q=', '&t=web')) AS e(engine, pos, head, tail)""")
def search_fanout(spark, sf):
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("UY").alias("country")
    )
    return serp.search_urls(asked)


def result_pages(spark, sf):
    """Each stored page's links set out as a result page of every engine."""
    pages = table(spark, sf, "pages")
    root = F.regexp_extract("url", r"^https?://[^/?#]+", 0)
    links = F.transform(urls.link_matches(F.col("html")), lambda l: F.concat(root, l))
    plain = lambda l: F.concat(F.lit('href="'), l, F.lit('"'))
    ddg = F.transform(links, lambda l: F.concat(
        F.lit('<div><h2><a class="result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode(l), F.lit('">Titulo</a></h2><a class="result__snippet">Texto</a></div>')))
    start = F.transform(links, lambda l: F.concat(
        F.lit('<div class="w-gl__result"><a class="w-gl__result-title" '), plain(l), F.lit('>Titulo</a><p class="w-gl__description">Texto</p></div>')))
    ecosia = F.transform(links, lambda l: F.concat(
        F.lit('<div data-test-id="mainline-result-web"><h2><a '), plain(l), F.lit('>Titulo</a></h2><p>Texto</p></div>')))
    qwant = F.transform(links, lambda l: F.concat(
        F.lit('<div data-testid="webResult"><a data-testid="serTitle" '), plain(l), F.lit('>Titulo</a><span data-testid="serDescription">Texto</span></div>')))
    google = F.transform(links, lambda l: F.concat(
        F.lit('<div class="g"><a href="/url?url='), F.url_encode(l), F.lit('&sa=1"><h3>Titulo</h3></a><span class="st">Texto</span></div>')))
    engines = F.array(*[
        F.struct(F.lit(name).alias("engine"), F.concat(F.lit("<html><body>"), F.array_join(blocks, ""), F.lit("</body></html>")).alias("html"))
        for name, blocks in (("duckduckgo", ddg), ("startpage", start), ("ecosia", ecosia), ("qwant", qwant), ("google", google))
    ])
    return pages.select(F.col("page_id").alias("query_id"), F.explode(engines).alias("e")).select("query_id", "e.engine", "e.html")


_LINKS = """l AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS root, regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1) AS refs FROM pages),
    links AS (SELECT page_id, root, unnest(refs) AS ref, unnest(range(len(refs))) AS n, root || unnest(refs) AS u FROM l)"""


@query("serp_hits", f"""WITH {_LINKS}, {U.sanitized('links')},
    h AS (SELECT page_id, clean, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos FROM sanitized_rows WHERE clean IS NOT NULL)
    SELECT page_id AS query_id, engine, pos, 'Titulo' AS title, clean AS url, 'Texto' AS description
    FROM h, (SELECT unnest(['duckduckgo', 'startpage', 'ecosia', 'qwant', 'google']) AS engine) WHERE pos < 20""")
def serp_hits(spark, sf):
    return serp.parse_result_pages(result_pages(spark, sf), max_hits=20)


@query("serp_text_hits", """SELECT p_partkey AS query_id, 0 AS pos, 'Oferta de ' || p_name AS title, 'https://www.tienda' || p_partkey || '.com.uy/p/' || p_partkey AS url,
    left('https://www.tienda' || p_partkey || '.com.uy/p/' || p_partkey || ' Envio a todo el pais de ' || p_name, 101) AS description FROM part UNION ALL
    SELECT -1 - p_partkey, 0, '9' || p_partkey, 'https://www.9' || p_partkey || '.uy/' || p_partkey, 'Product search result from 9' || p_partkey || '.uy' FROM part""")
def serp_text_hits(spark, sf):
    """Plain result text: a title line above a URL, and a URL alone."""
    part = table(spark, sf, "part", spread=True)
    key = F.col("p_partkey").cast("string")
    link = F.concat(F.lit("https://www.tienda"), key, F.lit(".com.uy/p/"), key)
    titled = part.select(
        F.col("p_partkey").alias("query_id"), F.concat(F.lit("Web results Oferta de "), F.col("p_name"), F.lit("\n"), link, F.lit(" Envio a todo el pais de "), F.col("p_name"), F.lit("\n")).alias("body")
    )
    alone = part.select((-1 - F.col("p_partkey")).alias("query_id"), F.concat(F.lit("https://www.9"), key, F.lit(".uy/"), key, F.lit("\n12\n")).alias("body"))
    return serp.text_hits(titled.unionByName(alone), "body")


_MARKERS = "CASE " + " ".join(f"WHEN contains(lower(x), '{m}') THEN 'marker:{m}'" for m in rules.BLOCKED_HTML_MARKERS) + " END"


@query("blocked_pages", f"""WITH s AS (SELECT 'd' || doc_id AS id, text AS x FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages
      UNION ALL SELECT 'r' || page_id, html || ' Access denied: unusual traffic' FROM pages UNION ALL SELECT 'e' || page_id, '' FROM pages),
    r AS (SELECT id, x, concat_ws(',', CASE WHEN length(x) < 2000 THEN 'tiny_html:' || length(x) END, {_MARKERS}) AS why FROM s)
    SELECT id, x = '' OR why <> '' AS blocked, CASE WHEN x = '' THEN 'empty_html' WHEN why = '' THEN 'ok' ELSE why END AS reason FROM r""")
def blocked_pages(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("html"))
    pages = table(spark, sf, "pages").select(
        F.explode(F.array(
            F.struct(F.concat(F.lit("p"), "page_id").alias("id"), "html"),
            F.struct(F.concat(F.lit("r"), "page_id").alias("id"), F.concat("html", F.lit(" Access denied: unusual traffic")).alias("html")),
            F.struct(F.concat(F.lit("e"), "page_id").alias("id"), F.lit("").alias("html")),
        )).alias("v")
    ).select("v.*")
    return serp.flag_blocked(docs.unionByName(pages), min_chars=2000).select("id", "blocked", "reason")


@query("blocked_texts", """SELECT conv_id, turn, regexp_matches(lower(text || role), 'captcha|verify you are|unusual traffic|robot|access denied') AS blocked FROM conversations""")
def blocked_texts(spark, sf):
    mark = text.blocked_text(F.concat("text", "role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", mark["blocked"].alias("blocked"))


_ENGINES = ["duckduckgo", "startpage", "ecosia", "qwant", "google"]
_AT = "2024-01-20 12:00:00"


def fetch_log(spark, sf):
    """Events as fetches of five engines."""
    names = F.array(*[F.lit(e) for e in _ENGINES])
    return table(spark, sf, "events").select(
        F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("engine"),
        "ts",
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("outcome"),
        F.floor(F.col("value") * 1000).alias("html_len"),
        F.when(F.col("event_type") == "click", 0).otherwise(F.get_json_object("props", "$.k").cast("int")).alias("hits"),
        (F.col("event_type") == "click").alias("blocked"),
    )


_BREAKER = f"""log AS (SELECT ({sql_list(_ENGINES)})[1 + user_id % 5] AS engine, ts, event_type, floor(value * 1000) AS html_len,
      CASE WHEN event_type = 'click' THEN 0 ELSE (props->>'$.k')::INT END AS hits FROM events WHERE ts <= TIMESTAMP '{_AT}'),
    ev AS (SELECT engine, ts, CASE WHEN event_type = 'error' OR html_len < 2000 THEN 'open' WHEN hits = 0 AND event_type = 'click' THEN 'open'
      WHEN hits > 0 THEN 'close' ELSE 'none' END AS event FROM log),
    st AS (SELECT engine, max_by(event, ts) AS event, max(ts) AS since FROM ev WHERE event <> 'none' GROUP BY engine),
    state AS (SELECT *, event = 'open' AND since > TIMESTAMP '{_AT}' - INTERVAL 86400 SECONDS AS is_open FROM st)"""


@query("engine_breaker", f"WITH {_BREAKER} SELECT engine, event, {sql_stamp('since')} AS since, is_open FROM state")
def engine_breaker(spark, sf):
    state = serp.breaker_state(fetch_log(spark, sf), F.lit(_AT).cast("timestamp"), 86400, min_chars=2000)
    return state.select("engine", "event", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "is_open")


@query("engine_choice", f"""WITH {_BREAKER}, asked AS (SELECT item_id AS query_id, e.engine, coalesce(is_open, false) AS is_open FROM benchmark,
      (SELECT unnest(['duckduckgo', 'startpage', 'ecosia', 'qwant']) AS engine) e LEFT JOIN state s ON s.engine = e.engine),
    c AS (SELECT query_id, count(*) FILTER (NOT is_open) AS closed, list(engine) FILTER (is_open) AS opened FROM asked GROUP BY query_id),
    p AS (SELECT query_id, CASE closed WHEN 0 THEN ([x FOR x IN {sql_list(rules.PROBE_ORDER_ALL_OPEN)} IF list_contains(opened, x)])[1]
      WHEN 1 THEN ([x FOR x IN {sql_list(rules.PROBE_ORDER_ONE_LEFT)} IF list_contains(opened, x)])[1] END AS probe FROM c)
    SELECT query_id, engine, coalesce(is_open AND engine = probe, false) AS is_probe FROM asked JOIN p USING (query_id) WHERE NOT is_open OR engine = probe""")
def engine_choice(spark, sf):
    state = serp.breaker_state(fetch_log(spark, sf), F.lit(_AT).cast("timestamp"), 86400, min_chars=2000)
    asked = serp.search_urls(table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("UY").alias("country")
    )).select("query_id", "engine")
    return serp.enabled_engines(asked, state)


@query("result_budget", """WITH h AS (SELECT l_suppkey AS query_id, 'https://shop.example.com/p/' || l_partkey AS url, min(l_orderkey * 8 + l_linenumber) AS pos FROM lineitem GROUP BY ALL)
    SELECT query_id, url, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos, url) AS rank FROM h QUALIFY rank <= 40""")
def result_budget(spark, sf):
    hits = table(spark, sf, "lineitem", spread=True).select(
        F.col("l_suppkey").alias("query_id"),
        F.concat(F.lit("https://shop.example.com/p/"), F.col("l_partkey").cast("string")).alias("url"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
    )
    return serp.result_budget(hits, 40)


@query("flattened_results", f"""WITH {_LINKS}, q AS (SELECT regexp_extract(root, '[a-z]+$') AS query_id, page_id, n, u || CASE WHEN n % 2 = 0 THEN ' › x' ELSE '' END AS u FROM links),
    {U.sanitized('q')} SELECT query_id, clean AS url, 'page ' || page_id AS source_query, 'T' || n AS original_title FROM sanitized_rows WHERE clean IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY query_id, clean ORDER BY page_id, n) = 1""")
def flattened_results(spark, sf):
    """One nested response per page; a search covers the pages of one top-level domain."""
    root = F.regexp_extract("url", r"^https?://[^/?#]+", 0)
    hits = F.transform(
        urls.link_matches(F.col("html")),
        lambda l, n: F.struct(
            F.concat(root, l, F.when(n % 2 == 0, " › x").otherwise("")).alias("url"),
            F.concat(F.lit("T"), n).alias("title"), F.lit("D").alias("description"),
        ),
    )
    results = table(spark, sf, "pages").select(
        F.regexp_extract(root, "[a-z]+$", 0).alias("query_id"),
        F.concat(F.lit("page "), "page_id").alias("query"),
        F.col("page_id").alias("pos"),
        F.struct(F.struct(hits.alias("results")).alias("web")).alias("results"),
    )
    return cand.flatten_results(results).select("query_id", "url", "source_query", "original_title")


# -- candidate filters -----------------------------------------------------------------------
_MORE = ["spam-farm.example.org", "cheap-pills.example.com", "example.net"]


@query("domain_blocklist", f"SELECT page_id, {_BLOCKED.format(d=sql_list(rules.BLOCKED_DOMAINS + _MORE))} AS blocked FROM pages")
def domain_blocklist(spark, sf):
    test = cand.is_blocked_domain(F.col("url"), rules.BLOCKED_DOMAINS + _MORE)
    return table(spark, sf, "pages").select("page_id", test.alias("blocked"))


_SECTIONS = """sec AS (SELECT page_id, unnest(range(7)) AS kind, unnest([url, regexp_extract(url, '^https?://[^/?#]+') || '/help/' || page_id,
      regexp_extract(url, '^https?://[^/?#]+') || '/docs/' || page_id || '.PDF', 'shop/categories/', url || '/product/9',
      regexp_extract(url, '^https?://[^/?#]+') || '/p/MLU' || page_id, regexp_extract(url, '^https?://[^/?#]+') || '/products/' || page_id]) AS url FROM pages)"""


def section_urls(spark, sf):
    url, key = F.col("url"), F.col("page_id").cast("string")
    root = F.regexp_extract("url", r"^https?://[^/?#]+", 0)
    kinds = F.array(
        url, F.concat(root, F.lit("/help/"), key), F.concat(root, F.lit("/docs/"), key, F.lit(".PDF")), F.lit("shop/categories/"),
        F.concat(url, F.lit("/product/9")), F.concat(root, F.lit("/p/MLU"), key), F.concat(root, F.lit("/products/"), key),
    )
    return table(spark, sf, "pages").select("page_id", F.posexplode(kinds).alias("kind", "url"))


@query("candidate_tags", f"""WITH {_SECTIONS} SELECT page_id, kind, {_BLOCKED.format(d=sql_list(rules.BLOCKED_DOMAINS))} AS blocked_domain,
    {_EXCLUDED.format(u='url')} AS excluded, regexp_matches(lower(url), '(?i){"|".join(rules.PRIORITY_PATTERNS)}') AS high_priority FROM sec""")
def candidate_tags(spark, sf):
    return cand.tag_filters(section_urls(spark, sf)).drop("url")


@query("pattern_exclude", f"WITH {_SECTIONS} SELECT page_id, kind, url FROM sec WHERE NOT {_EXCLUDED.format(u='url')}")
def pattern_exclude(spark, sf):
    return cand.pattern_filter(section_urls(spark, sf))


@query("host_cap", f"""WITH h AS (SELECT l_suppkey AS query_id, 'https://www.shop' || l_partkey % 7 || '.example.com/p/' || l_partkey || CASE WHEN l_linenumber > 3 THEN '?ref=x' ELSE '/' END AS url,
      l_orderkey * 8 + l_linenumber AS pos FROM lineitem), {_CAPPED.format(source='h', cap=10)} SELECT query_id, host, url, pos, host_rank FROM capped""")
def host_cap(spark, sf):
    """Seven hosts hold every offer page of a shop."""
    key = F.col("l_partkey")
    hits = table(spark, sf, "lineitem", spread=True).select(
        F.col("l_suppkey").alias("query_id"),
        F.concat(
            F.lit("https://www.shop"), (key % 7).cast("string"), F.lit(".example.com/p/"), key.cast("string"),
            F.when(F.col("l_linenumber") > 3, "?ref=x").otherwise("/"),
        ).alias("url"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
    )
    return cand.host_cap(hits, 10).select("query_id", "host", "url", "pos", "host_rank")


@query("filter_funnel", f"""WITH h AS (SELECT 1 AS query_id, page_id * 8 + kind AS pos, url FROM (WITH {_SECTIONS} SELECT * FROM sec)),
    kept AS (SELECT * FROM h WHERE NOT {_EXCLUDED.format(u='url')}), {_CAPPED.format(source='kept', cap=3)}
    SELECT (SELECT count(*) FROM h) AS initial, (SELECT count(*) FROM h) AS after_blocklist, (SELECT count(*) FROM kept) AS after_patterns,
    (SELECT count(*) FROM capped) AS final, round(((SELECT count(*) FROM h) - (SELECT count(*) FROM capped)) / (SELECT count(*) FROM h) * 100, 2) AS reduction_pct""")
def filter_funnel(spark, sf):
    rows = section_urls(spark, sf).select(F.lit(1).alias("query_id"), (F.col("page_id") * 8 + F.col("kind")).alias("pos"), "url")
    return cand.filter_funnel(rows, 3)


@query("enhanced_queries", """WITH q AS (SELECT p_partkey AS query_id, p_name || CASE WHEN p_size > 25 THEN ' montevideo' ELSE '' END AS query FROM part),
    t AS (SELECT query_id, query, contains(query, 'montevideo') AS has_place FROM q)
    SELECT query_id, query, 'UY' AS country, has_place, unnest(range(CASE WHEN has_place THEN 1 ELSE 4 END)) AS pos,
      unnest(CASE WHEN has_place THEN [query] ELSE [query || ' Uruguay', 'comprar ' || query || ' Uruguay', query || ' Montevideo', query || ' tienda Uruguay'] END) AS enhanced FROM t""")
def enhanced_queries(spark, sf):
    asked = table(spark, sf, "part", spread=True).select(
        F.col("p_partkey").alias("query_id"),
        F.concat("p_name", F.when(F.col("p_size") > 25, " montevideo").otherwise("")).alias("query"),
        F.lit("UY").alias("country"),
    )
    return cand.enhance_queries(asked)


@query("response_reconcile", """SELECT 'q' || d.doc_id AS query, CASE WHEN quality IS NULL OR toxic = 1 THEN false ELSE quality = 1 END AS valid,
    CASE WHEN quality IS NULL THEN 'missing from response' WHEN toxic = 1 THEN 'malformed response item' ELSE 'judged' END AS reason
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def response_reconcile(spark, sf):
    name = F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query")
    answers = table(spark, sf, "labels").select(
        name, F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("valid"), F.lit("judged").alias("reason")
    )
    return cand.reconcile_responses(table(spark, sf, "documents").select(name), answers)


# -- geography -------------------------------------------------------------------------------
_COUNTRIES = list(rules.COUNTRY_TLDS)
_PLACES = ["Uruguay", "brasil", "USA", "España", "Narnia"]
_CITIES = ["Montevideo", "salvador", "Chicago", "Atlantis", ""]


@query("place_check", f"""WITH c AS (SELECT c_custkey, ({sql_list(_PLACES)})[1 + c_nationkey % 5] AS country, ({sql_list(_CITIES)})[1 + c_custkey % 5] AS city FROM customer),
    k AS (SELECT *, CASE country WHEN 'Uruguay' THEN 'UY' WHEN 'brasil' THEN 'BR' WHEN 'USA' THEN 'US' WHEN 'España' THEN 'ES' END AS country_code FROM c)
    SELECT c_custkey, country_code, CASE WHEN country_code IS NULL THEN 'invalid_country' WHEN city <> '' AND NOT ((country_code = 'UY' AND city = 'Montevideo')
      OR (country_code = 'BR' AND city = 'salvador') OR (country_code = 'US' AND city = 'Chicago')) THEN 'invalid_city' END AS reject_reason FROM k""")
def place_check(spark, sf):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % 5 + 1).cast("int"))
    asked = table(spark, sf, "customer").select(
        "c_custkey", pick(_PLACES, F.col("c_nationkey")).alias("country"), pick(_CITIES, F.col("c_custkey")).alias("city")
    )
    accepted, rejected = geography.check_places(asked)
    return accepted.select("c_custkey", "country_code", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejected.select("c_custkey", "country_code", "reject_reason")
    )


_HOSTS = [
    "tienda.com.uy", "www.mercadolibre.com.ar", "shop-uruguay.com", "br.tienda.com", "exito.com", "tienda.es", "uyuni.example.org",
    "loja.com.br:8080", "amazon.com", "pricelist.net",
]
_PATHS = ["/uy/p/1", "/p/1?country=uy", "/montevideo", "/es/lima/x", "/x?location=salto"]


def shop_urls(spark, sf):
    """Shops on varied hosts and paths, asked for a country each."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key, F.explode(F.array(*[F.lit(c) for c in _COUNTRIES])).alias("country"),
        F.concat(F.lit("https://"), pick(_HOSTS, key), pick(_PATHS, F.floor(key / 10))).alias("url"),
        F.lit("Salto").alias("city"),
    )


_SHOPS = f"""shops AS (SELECT s_suppkey, unnest({sql_list(_COUNTRIES)}) AS country,
      'https://' || ({sql_list(_HOSTS)})[1 + s_suppkey % 10] || ({sql_list(_PATHS)})[1 + (s_suppkey // 10) % 5] AS url FROM supplier),
    net AS (SELECT *, lower({U.netloc('url')}) AS h, lower({U.path('url')}) AS p, lower({U.query_part('url')}) AS q FROM shops)"""


def _per_country(test) -> str:
    return "CASE country " + " ".join(f"WHEN '{c}' THEN {test(c)}" for c in _COUNTRIES) + " END"


_SUFFIX = lambda c: "(" + " OR ".join(f"ends_with(h, '{t}')" for t in rules.COUNTRY_TLDS[c]) + f" OR h IN {sql_in(rules.COUNTRY_SHOPS[c])}"
_HOST_COMPAT = _per_country(lambda c: _SUFFIX(c) + " OR " + " OR ".join(f"contains(h, '{w}')" for w in rules.COUNTRY_HOST_WORDS[c]) + ")")
_HOST_LABEL = _per_country(lambda c: _SUFFIX(c) + f" OR list_has_any(regexp_split_to_array(h, '[.:-]'), {sql_list(w for w in rules.COUNTRY_HOST_WORDS[c] if '.' not in w)}))")
_PATH_OK = _per_country(lambda c: "(" + " OR ".join(f"contains(p, '{w}') OR contains(q, '{w}')" for w in rules.COUNTRY_PATH_WORDS[c]) + ")")
_CITY_OK = "(contains(p, '/salto/') OR contains(p, 'city=salto') OR contains(p, 'location=salto') OR contains(q, '/salto/') OR contains(q, 'city=salto') OR contains(q, 'location=salto'))"
_FOREIGN = "(" + " OR ".join(f"ends_with(lower(url), '{t}') OR contains(lower(url), '{t}/')" for t in rules.FOREIGN_TLDS) + ")"


@query("geo_domain", f"WITH {_SHOPS} SELECT s_suppkey, country, {_HOST_LABEL} AS by_label, {_HOST_COMPAT} AS by_substring FROM net")
def geo_domain(spark, sf):
    u, c = F.col("url"), F.col("country")
    return shop_urls(spark, sf).select(
        "s_suppkey", "country", geo.is_country_host(u, c).alias("by_label"), geo.is_country_host(u, c, "compat").alias("by_substring")
    )


@query("geo_path", f"WITH {_SHOPS} SELECT s_suppkey, country, {_PATH_OK} AS country_path, {_PATH_OK} OR {_CITY_OK} AS country_or_city FROM net")
def geo_path(spark, sf):
    u, c = F.col("url"), F.col("country")
    return shop_urls(spark, sf).select(
        "s_suppkey", "country", geo.has_country_path(u, c).alias("country_path"), geo.has_country_path(u, c, F.col("city")).alias("country_or_city")
    )


@query("geo_foreign", f"WITH {_SHOPS} SELECT s_suppkey, country, url FROM net WHERE NOT {_FOREIGN}")
def geo_foreign(spark, sf):
    return geography.drop_foreign(shop_urls(spark, sf)).select("s_suppkey", "country", "url")


@query("geo_home", f"""WITH {_SHOPS} SELECT s_suppkey, country, (ends_with(h, '.uy') OR contains(h, 'uruguay')
    OR regexp_matches(p || '?' || q, 'uruguay|/uy/|montevideo')) AS home FROM net""")
def geo_home(spark, sf):
    return shop_urls(spark, sf).select("s_suppkey", "country", geo.is_home_url(F.col("url")).alias("home"))


@query("geo_validate", f"""WITH {_SHOPS}, d AS (SELECT url, bool_or(s_acctbal > 0) AS ok FROM net JOIN supplier USING (s_suppkey) WHERE country = 'UY' AND s_nationkey < 8 GROUP BY url)
    SELECT s_suppkey, country, CASE WHEN country = 'UY' AND d.ok IS NOT NULL THEN CASE WHEN d.ok THEN 'true' ELSE 'false' END
      WHEN {_HOST_LABEL} OR {_PATH_OK} OR {_CITY_OK} THEN 'true' ELSE 'unresolved' END AS geo_status FROM net LEFT JOIN d USING (url)""")
def geo_validate(spark, sf):
    shops = shop_urls(spark, sf)
    supplier = table(spark, sf, "supplier").filter("s_nationkey < 8").select("s_suppkey", (F.col("s_acctbal") > 0).alias("ok"))
    known = (
        shops.filter("country = 'UY'").join(supplier, "s_suppkey").groupBy("country", "url").agg(F.max("ok").alias("ok"))
        .select(
            F.lit("geo").alias("kind"), store.decision_key("country", "url").alias("key"),
            F.when(F.col("ok"), "1").otherwise("0").alias("value"), F.lit("2024-01-19").cast("timestamp").alias("decided_at"),
        )
    )
    return geography.validate(shops, known, F.lit("2024-01-20").cast("timestamp")).select("s_suppkey", "country", "geo_status")


# -- page types ------------------------------------------------------------------------------
def typed_rows(spark, sf):
    from checks.urls import site_urls

    return site_urls(spark, sf).unionByName(
        shop_urls(spark, sf).filter("country = 'UY'").select("s_suppkey", F.lit(9).alias("kind"), "url")
    )


@query("page_types", f"""WITH {_SHOPS}, s AS (SELECT s_suppkey, unnest(range(6)) AS kind, unnest([
        'https://listado.mercadolibre.com.uy/x-' || s_suppkey, 'https://www.mercadolibre.com.uy/c/' || s_suppkey,
        'https://www.mercadolibre.com.uy/item/p/MLU' || s_suppkey, 'https://articulo.mercadolibre.com.uy/MLU-' || s_suppkey || '-x',
        'https://tienda' || s_suppkey || '.com.uy/ver?sku=' || s_suppkey, 'https://tienda' || s_suppkey || '.com.uy/hogar']) AS url FROM supplier),
    a AS (SELECT * FROM s UNION ALL SELECT s_suppkey, 9, url FROM shops WHERE country = 'UY'),
    n AS (SELECT *, lower({U.netloc('url')}) AS h, lower({U.path('url')}) AS p, lower({U.query_part('url')}) AS q FROM a)
    SELECT s_suppkey, kind, CASE WHEN NOT (ends_with(h, '.uy') OR contains(h, 'uruguay') OR regexp_matches(p || '?' || q, 'uruguay|/uy/|montevideo')) THEN 'EXCLUDE_NON_URUGUAY'
      WHEN kind IN (0, 1) THEN 'CATEGORY' WHEN kind IN (2, 3) THEN 'PRODUCT' WHEN {U.is_product('url')} OR {U.single_product('url')} THEN 'PRODUCT' ELSE 'UNRESOLVED' END AS page_type FROM n""")
def page_types(spark, sf):
    return pagetypes.page_type(typed_rows(spark, sf)).select("s_suppkey", "kind", "page_type")


@query("page_type_errors", "SELECT count(*) FILTER (event_type <> 'error') AS kept, count(*) FILTER (event_type = 'error') AS dropped FROM events")
def page_type_errors(spark, sf):
    rows = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "ERROR_PARSING_JSON").otherwise("PRODUCT").alias("page_type")
    )
    return pagetypes.error_counts(rows)


@query("page_type_kept", "SELECT event_id FROM events WHERE event_type <> 'error'")
def page_type_kept(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "ERROR_PARSING_JSON").otherwise("PRODUCT").alias("page_type")
    )
    return pagetypes.drop_errors(rows).select("event_id")


def shop_host(key):
    return F.concat(F.lit("https://shop"), (key % 20).cast("string"), F.lit(".example.com.uy"))


def shop_page(key):
    return F.concat(shop_host(key), F.lit("/rubro/"), key.cast("string"))


def shop_link(host):
    """Link of a part (columns p_name, l_partkey) on the page of its shop."""
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    at = F.when(F.col("p_name").startswith("old"), F.lit("https://other.example.com")).otherwise(host)
    return F.concat(at, F.lit("/producto/"), slug, F.lit("/producto/"), F.col("l_partkey").cast("string"))


def category_tables(spark, sf):
    """A category page per shop of a country (the search); its links are the shop's parts."""
    key = F.col("s_suppkey")
    host = shop_host(key)
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("query_id"), shop_page(key).alias("url"),
        key.alias("pos"), F.array(F.lit("producto"), F.lit("red")).alias("terms"), "s_suppkey", host.alias("host"),
    )
    sold = (
        table(spark, sf, "lineitem", spread=True).groupBy("l_suppkey", "l_partkey").agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
        .join(table(spark, sf, "part", spread=True).select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    )
    edges = sold.join(suppliers.select("s_suppkey", F.col("url").alias("src"), "host"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        "src",
        shop_link(F.col("host")).alias("dst"),
        "pos",
    )
    return suppliers.select("query_id", "url", "pos", "terms"), edges


_EXPANDED = """cats AS (SELECT s_nationkey AS query_id, s_suppkey, 'shop' || s_suppkey % 20 || '.example.com.uy' AS host FROM supplier),
    sold AS (SELECT l_suppkey, l_partkey, min(l_orderkey * 8 + l_linenumber) AS pos FROM lineitem GROUP BY ALL),
    lk AS (SELECT query_id, host, s_suppkey AS src_pos, pos, 'https://' || host || '/producto/' || replace(p_name, ' ', '-') || '/' || l_partkey AS url
      FROM cats JOIN sold ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE NOT starts_with(p_name, 'old')),
    hc AS (SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY query_id, host ORDER BY src_pos, pos, url) <= 8),
    qc AS (SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY src_pos, pos, url) <= 50),
    expanded AS (SELECT * FROM qc QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY src_pos, pos) = 1)"""


@query("category_expansion", f"WITH {_EXPANDED} SELECT query_id, url, host AS src_host, src_pos, pos FROM expanded")
def category_expansion(spark, sf):
    categories, edges = category_tables(spark, sf)
    return pagetypes.expand_categories(categories, edges, 8, 50).select("query_id", "url", "src_host", "src_pos", "pos")


@query("category_low_yield", f"""WITH {_EXPANDED}, l AS (SELECT query_id, count(*) AS links FROM expanded GROUP BY ALL), a AS (SELECT query_id, count(*) AS categories FROM cats GROUP BY ALL)
    SELECT query_id, categories, coalesce(links, 0) AS links, coalesce(links, 0) < 5 AND categories <= 3 AS per_page_retry, coalesce(links, 0) < 3 AS needs_labels FROM a LEFT JOIN l USING (query_id)""")
def category_low_yield(spark, sf):
    categories, edges = category_tables(spark, sf)
    return pagetypes.low_yield(categories, pagetypes.expand_categories(categories, edges, 8, 50))


@query("category_merge", f"""WITH {_EXPANDED}, have AS (SELECT query_id, url, pos FROM expanded WHERE pos % 2 = 0),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src_pos, pos, url) AS r FROM expanded t
      WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.query_id = t.query_id AND h.url = t.url))
    SELECT query_id, url, 'own' AS original_title, pos FROM have UNION ALL
    SELECT query_id, url, 'Expanded from category', coalesce((SELECT max(pos) FROM have h WHERE h.query_id = top.query_id), -1) + r FROM top WHERE r <= 10""")
def category_merge(spark, sf):
    categories, edges = category_tables(spark, sf)
    expanded = cut_lineage(pagetypes.expand_categories(categories, edges, 8, 50))  # used by several branches
    have = expanded.filter("pos % 2 = 0").select(
        "query_id", "url", F.lit("own").alias("original_title"), F.lit("").alias("original_snippet"), F.lit("PRODUCT").alias("page_type"), "pos"
    )
    return pagetypes.merge_expanded(have, expanded, 10).select("query_id", "url", "original_title", "pos")


@query("category_fallback", f"""WITH {_EXPANDED.replace("<= 8)", "<= 1)")}, few AS (SELECT s_nationkey AS query_id FROM supplier LEFT JOIN expanded ON query_id = s_nationkey GROUP BY s_nationkey HAVING count(DISTINCT url) < 3)
    SELECT s_nationkey AS query_id, 'https://shop' || s_suppkey % 20 || '.example.com.uy/producto/' || replace(p_name, ' ', '-') || '/producto/' || l_partkey AS url
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE NOT starts_with(p_name, 'old') AND s_nationkey IN (SELECT query_id FROM few) GROUP BY ALL""")
def category_fallback(spark, sf):
    """With one link per host some searches find too little."""
    categories, edges = category_tables(spark, sf)
    low = pagetypes.low_yield(categories, pagetypes.expand_categories(categories, edges, 1, 50))
    return pagetypes.fallback_links(categories, edges, low).select("query_id", "url")
