"""SQL fragments for URL rules, written from the rule descriptions."""

from __future__ import annotations

from checks.common import sql_any_contains, sql_in
from pricelake.functions import rules

LEGAL = r"\p{L}\p{N}_\-._~:/?#\[\]@!$&''()*+,;=%"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def path(u: str) -> str:
    raw = f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    return f"regexp_replace({raw}, ';[^/]*$', '')"


def query_part(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def fragment(u: str) -> str:
    return f"regexp_extract({u}, '#(.*)$', 1)"


def host(u: str) -> str:
    return f"regexp_replace(lower({netloc(u)}), '^www\\.', '')"


def sanitized(source: str, col: str = "u", out: str = "clean") -> str:
    """CTE chain ending in ``sanitized_rows``: every column of ``source`` plus ``out``."""
    return f"""
    z1 AS (SELECT *, regexp_extract({col}, '^[^›‹»«]*') AS zu FROM {source}),
    z2 AS (SELECT * REPLACE (regexp_replace(zu, '^(.+?)https?://.*$', '\\1') AS zu) FROM z1),
    z3 AS (SELECT * REPLACE (regexp_replace(zu, '[^{LEGAL}]+$', '') AS zu) FROM z2),
    z4 AS (SELECT * REPLACE (regexp_replace(zu, '/[^/]*[^{LEGAL}][^/]*$', '') AS zu) FROM z3),
    z5 AS (SELECT * REPLACE (regexp_replace(zu, '\\.+$', '') AS zu) FROM z4),
    z6 AS (SELECT *, regexp_extract(zu, '(\\.(?:com\\.uy|gub\\.uy|org\\.uy|edu\\.uy|net\\.uy|uy|com|org|net))(\\.[A-Z][a-zA-Z]+)(?:/|$)', 2) AS zj FROM z5),
    z7 AS (SELECT * REPLACE (CASE WHEN zj <> '' THEN left(zu, instr(zu, zj) - 1) || substr(zu, instr(zu, zj) + length(zj)) ELSE zu END AS zu) FROM z6),
    z8 AS (SELECT *, lower({netloc('zu')}) AS zn FROM z7),
    z9 AS (SELECT *, string_split(zn, '.') AS zl FROM z8),
    sanitized_rows AS (SELECT * EXCLUDE (zu, zj, zn, zl), CASE WHEN {scheme('zu')} IN ('http', 'https') AND contains(zn, '.')
        AND NOT ends_with(zn, '.') AND NOT contains(zn, '..')
        AND NOT ((length(zl[-1]) > 10 OR NOT regexp_full_match(zl[-1], '\\p{{L}}+')) AND (len(zl) < 2 OR length(zl[-2]) > 10))
        THEN zu END AS {out} FROM z9)"""


def normalized(u: str, drop_query: bool = False) -> str:
    base = (
        f"{scheme(f'lower(trim({u}))')} || '://' || regexp_replace({netloc(f'lower(trim({u}))')}, '^www\\.', '')"
        f" || regexp_replace({path(f'lower(trim({u}))')}, '/+$', '')"
    )
    if drop_query:
        return f"({base})"
    kept = (
        f"array_to_string([p FOR p IN string_split({query_part(f'lower(trim({u}))')}, '&')"
        f" IF NOT (contains(p, '=') AND string_split(p, '=')[1] IN {sql_in(rules.TRACKING_PARAMS)})], '&')"
    )
    return f"({base} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"


def is_product(u: str, terms: str | None = None) -> str:
    low = f"lower({u})"
    parts = f"string_split({low}, '/')"
    deep = f"len([s FOR s IN {parts}[4:] IF length(s) > 2 AND NOT regexp_full_match(s, '[0-9]+')]) >= 2"
    named = ""
    if terms:
        named = f" OR (len([t FOR t IN {terms} IF length(t) > 2 AND contains({low}, lower(t))]) > 0 AND len({parts}) >= 4)"
    return (
        f"(NOT {sql_any_contains(low, rules.PRODUCT_EXCLUDE_TOKENS)} AND NOT {sql_any_contains(low, rules.PRODUCT_PAGING_TOKENS)}"
        f" AND ({sql_any_contains(low, rules.PRODUCT_STRONG_TOKENS)} OR ends_with(rtrim({low}, '/'), '/p')"
        f" OR regexp_matches({low}, '/[0-9]{{6,}}'){named} OR (len({parts}) >= 5 AND {deep})))"
    )


def matches_query(u: str, terms: str) -> str:
    low = f"lower({u})"
    usable = f"[lower(t) FOR t IN {terms} IF length(t) > 2]"
    return (
        f"(len({usable}) = 0 OR len([t FOR t IN {usable} IF contains({low}, t)]) > 0"
        f" OR len([s FOR s IN string_split({low}, '/') IF length(s) >= 4 AND len([t FOR t IN {usable} IF starts_with(t, s)]) > 0]) > 0)"
    )


def single_product(u: str) -> str:
    return f"regexp_matches(lower({u}), '" + "|".join(rules.SINGLE_PRODUCT_PATTERNS) + "')"


DIRTY = """
    dirty AS (SELECT page_id, unnest(range(8)) AS variant, unnest([
        url,
        url || ' › Tienda › ofertas',
        url || url,
        url || '...',
        url || '/mal formado"x',
        regexp_replace(url, '^https?:', 'ftp:'),
        regexp_replace(url, '^(https?://[^/?#]+).*$', '\\1.com.Visit/x'),
        upper(url) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'UTM_source=x&b=2'
    ]) AS u FROM pages)"""
