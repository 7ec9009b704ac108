"""URL Column expressions. Everything here stays inside the JVM (no Python worker).

Patterns use ``(?U)`` where Unicode letters must count as word characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import rules
from pricelake.functions.expr import let

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# scheme and authority alone; what follows matches anything, so they need not be read on
_HEAD = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?"
_LEGAL = r"\p{L}\p{N}_\-._~:/?#\[\]@!$&'()*+,;=%"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(col: Column, tokens: list[str]) -> Column:
    """Any of the plain texts stands in ``col``. Three or more with one first character are looked for in one pass, which
    stops at that character alone; a pattern over different ones would be slower than single tests."""
    quoted = lambda t: "".join(c if c.isalnum() else "\\" + c for c in t)
    groups: dict[str, list[str]] = {}
    for t in tokens:
        groups.setdefault(t[0], []).append(t)
    single = [col.contains(t) for ts in groups.values() if len(ts) < 3 for t in ts]
    joint = [col.rlike(f"{quoted(c)}(?:{'|'.join(quoted(t[1:]) for t in ts)})") for c, ts in groups.items() if len(ts) > 2]
    return any_of(joint + single)


# -- parts -----------------------------------------------------------------------------------
def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def netloc(url: Column) -> Column:
    """Authority including the port."""
    return F.regexp_extract(url, _HEAD, 1)


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, _HEAD + r"([^?#]*)", 2)


def path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(raw_path(url), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 5)


def host(url: Column) -> Column:
    """Canonical host used by caps: lower case, no leading ``www.``."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def url_parts(url: Column) -> Column:
    return F.struct(
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        path(url).alias("path"),
        query(url).alias("query"),
        fragment(url).alias("fragment"),
    )


# -- clean-up --------------------------------------------------------------------------------
_JUNK = (
    r"(?s)^(?=.*?\.(?:com\.uy|gub\.uy|org\.uy|edu\.uy|net\.uy|uy|com|org|net)(\.[A-Z][a-zA-Z]+)(?:/|$))(.*?)\1(.*)$"
)
# dotted host without empty labels; the last label is short and alphabetic, or the one before is short
_WEB_URL = (
    r"(?s)^(?i:https?)://(?![^/?#]*\.\.)"
    r"(?:(?:[^@/?#]*@)?\[[0-9A-Fa-f:.]*\.[0-9A-Fa-f:.]*\](?::\d+)?"
    r"|[^/?#\[\]]*\.\p{L}{1,10}"
    r"|(?:[^/?#\[\]]*\.)?[^./?#\[\]]{0,10}\.[^./?#\[\]]+)(?=[/?#]|$)"
)


def _repair(url: Column) -> Column:
    """Cut at breadcrumb marks, keep the first of joined URLs, drop illegal characters at the end and
    a last segment holding one, drop end dots and a capitalised word after the domain.
    """
    step = F.regexp_extract(url, rf"(?s)^[^{rules.BREADCRUMB_CHARS}]*", 0)
    step = F.regexp_replace(step, r"(?s)^(.+?)https?://.*$", "$1")
    step = F.regexp_replace(step, rf"[^{_LEGAL}]+$", "")
    step = F.regexp_replace(step, rf"/[^/]*[^{_LEGAL}][^/]*$", "")
    step = F.regexp_replace(step, r"\.+$", "")
    return F.regexp_replace(step, _JUNK, "$2$3")


# a URL of this form has nothing to repair: plain characters, one scheme, no capital after a dot
_SOUND = rf"^(?i:https?)://(?!.*https?://)(?!.*\.[A-Z])[{_LEGAL}]+(?<!\.)$"


def sanitize(url: Column) -> Column:
    """Repair a URL scraped from result text, or null when it cannot be a web URL."""
    return let(_repair(url), lambda clean: F.when(is_web_url(clean), clean))


# most URLs, seen in one pass without stepping back: sound, with the host of a web URL, and scheme, host and path alone
_SOUND_HOST, _SOUND_PATH = r"(?:[a-z0-9\-]++\.)++[a-z]{1,10}", r"(?:/[A-Za-z0-9_\-~/%]*+)?\z"
_SOUND_WEB = rf"^https?://{_SOUND_HOST}{_SOUND_PATH}"


def sound_host(url: Column) -> Column:
    """Canonical host of most web URLs that need no repair, empty for all others."""
    return F.regexp_extract(url, rf"^https?://(?:www\.)?+({_SOUND_HOST}){_SOUND_PATH}", 1)


def with_sanitized(df: DataFrame, url: str, name: str) -> DataFrame:
    """``sanitize`` as a column of its own. Sound URLs skip the repair, and the column stands behind an explode
    of one value, so filters above it use the value and do not repeat the work below."""
    u = F.col(url)
    repaired = let(F.when(u.rlike(_SOUND), u).otherwise(_repair(u)), lambda clean: F.when(is_web_url(clean), clean))
    one = F.explode_outer(F.array(F.when(u.rlike(_SOUND_WEB), u).otherwise(repaired)))
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, one.alias(name)).select(*(df.columns if name in df.columns else [*df.columns, name]))


def clean_rows(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows with a usable URL, repaired."""
    return with_sanitized(df, url, url).filter(F.col(url).isNotNull())


def is_web_url(url: Column) -> Column:
    """http(s) with a plausible dotted host."""
    return url.rlike(_WEB_URL)


def normalize(url: Column, drop_query: bool = False, keep_tracking: bool = False) -> Column:
    """Key for duplicate detection: lower case, no ``www.``, no trailing slash, no fragment."""
    # nothing to trim or cut: scheme, host and path alone
    return F.when(url.rlike(_SOUND_WEB), let(F.lower(url), _plain_key)).otherwise(_any_key(url, drop_query, keep_tracking))


def _plain_key(low: Column) -> Column:
    bare = lambda head: F.concat(F.lit(head), F.substr(low, F.lit(len(head) + 5)))
    named = F.when(low.startswith("https://www."), bare("https://")).when(low.startswith("http://www."), bare("http://")).otherwise(low)
    return F.when(low.endswith("/"), F.rtrim(named, F.lit("/"))).otherwise(named)


def _any_key(url: Column, drop_query: bool, keep_tracking: bool) -> Column:
    low = F.lower(F.btrim(url, F.lit(" \t\r\n\f\v\u00a0")))
    base = F.regexp_replace(low, r"(?s)[?#].*$", "")
    base = F.regexp_replace(base, r"^(?:([a-z][a-z0-9+.\-]*):)?(?://(?:www\.)?)?", "$1://")
    base = F.regexp_replace(base, r"/*(?:;[^/]*)?$", "")
    if drop_query:
        return base
    kept = F.regexp_extract(low, r"(?s)^[^?#]*(\?[^#]+)", 1)
    if not keep_tracking:
        names = "|".join(rules.TRACKING_PARAMS)
        kept = F.regexp_replace(kept, rf"&(?:{names})=[^&]*", "")
        kept = F.regexp_replace(kept, rf"^\?(?:{names})=[^&]*(?:&|$)", "?")
        kept = F.regexp_replace(kept, r"^\?$", "")
    return F.concat(base, kept)


def same_domain(base: Column, link: Column) -> Column:
    return let(netloc(link), lambda n: (n != "") & (n == netloc(base)))


# a web URL without these has scheme, authority and path alone, on one line: the pieces between slashes are all there is
_NOT_PLAIN = ["?", "#", ";", "\n", "\r", "\u0085", "\u2028", "\u2029"]


def drop_repeated_segments(url: Column) -> Column:
    """Keep the first of every path segment; a URL without a repeat is returned as it is."""

    def rebuilt(u: Column, segments: Column) -> Column:
        at = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", 0)
        rest = F.regexp_extract(u, r"(?s)^[^?#]*?((?:/?;[^/?#]*|/)?(?:\?[^#]*)?(?:#.*)?)$", 1)
        return F.concat(
            F.lower(F.regexp_extract(at, r"^[^:/]*:", 0)),
            F.regexp_extract(at, r"//.*$", 0),
            F.lit("/"),
            F.array_join(F.array_distinct(segments), "/"),
            F.regexp_replace(rest, r"\?(?=#|$)|#$", ""),
        )

    def fix(u: Column) -> Column:
        segments = F.filter(F.split(path(u), "/"), lambda s: s != "")
        return let(
            segments, lambda seg: F.when(F.size(F.array_distinct(seg)) < F.size(seg), rebuilt(u, seg)).otherwise(u)
        )

    def quick(u: Column) -> Column:
        return let(F.split(u, "/"), lambda parts: let(
            F.filter(F.slice(parts, 4, F.size(parts)), lambda s: s != ""),
            lambda seg: let(F.array_distinct(seg), lambda once: F.when(
                F.size(once) < F.size(seg),
                F.concat(F.array_join(F.slice(parts, 1, 3), "/"), F.lit("/"), F.array_join(once, "/"), F.when(u.endswith("/"), "/").otherwise("")),
            ).otherwise(u)),
        ))

    plain = lambda u: (u.startswith("http://") | u.startswith("https://")) & ~contains_any(u, _NOT_PLAIN)
    return let(url, lambda u: F.when(plain(u), quick(u)).otherwise(fix(u)))


# -- classification --------------------------------------------------------------------------
# Each test binds its URL once: a filter on a computed URL is pushed below the computing step, and
# the expression would otherwise be repeated for every use.
def usable_terms(terms: Column) -> Column:
    return F.filter(F.transform(terms, lambda t: F.lower(t)), lambda t: F.length(t) > 2)


def is_product_url(url: Column, terms: Column | None = None) -> Column:
    def test(low: Column) -> Column:
        parts = F.split(low, "/", -1)
        deep = F.filter(
            F.slice(parts, 4, F.size(parts)), lambda s: (F.length(s) > 2) & ~s.rlike(r"(?U)^\d+$")
        )
        yes = contains_any(low, rules.PRODUCT_STRONG_TOKENS) | low.rlike(r"/p/*$|(?U)/\d{6,}")
        if terms is not None:
            named = F.exists(usable_terms(terms), lambda t: F.contains(low, t)) & (F.size(parts) >= 4)
            yes = yes | F.coalesce(named, F.lit(False))
        yes = yes | ((F.size(parts) >= 5) & (F.size(deep) >= 2))
        no = contains_any(low, rules.PRODUCT_EXCLUDE_TOKENS + rules.PRODUCT_PAGING_TOKENS)
        return ~no & yes

    return let(F.lower(url), test)


def matches_query(url: Column, terms: Column) -> Column:
    """Any term in the URL, or a term that starts with a path part of four or more characters."""

    def test(s: Column) -> Column:
        low, wanted = s["low"], s["wanted"]
        parts = F.filter(F.split(low, "/"), lambda p: F.length(p) >= 4)
        named = F.exists(wanted, lambda t: F.contains(low, t))
        begun = F.exists(parts, lambda p: F.exists(wanted, lambda t: F.startswith(t, p)))
        return (F.size(wanted) == 0) | named | begun

    both = F.struct(F.lower(url).alias("low"), usable_terms(terms).alias("wanted"))
    return F.coalesce(let(both, test), F.lit(True))


def is_marketplace_listing(url: Column) -> Column:
    def test(s: Column) -> Column:
        where, at = s["where"], s["at"]
        inside = at.startswith("/listado") | at.contains("/listado/") | at.contains("/c/")
        return where.startswith(rules.MARKETPLACE_LISTING_HOST) | (where.isin(rules.MARKETPLACE_MAIN_HOSTS) & inside)

    return let(_place(url), test)


def is_marketplace_product(url: Column) -> Column:
    def test(s: Column) -> Column:
        where, at = s["where"], s["at"]
        return (where.endswith(rules.MARKETPLACE_DOMAIN) & at.contains("/p/") & at.contains("mlu")) | (
            where.startswith(rules.MARKETPLACE_PRODUCT_HOST) & at.startswith("/mlu-")
        )

    return let(_place(url), test)


def _place(url: Column) -> Column:
    return let(F.lower(url), lambda low: F.struct(netloc(low).alias("where"), path(low).alias("at")))


def is_single_product(url: Column) -> Column:
    return F.lower(url).rlike("|".join(rules.SINGLE_PRODUCT_PATTERNS))


def is_valid_request(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (netloc(url) != "")


def exclude_glob(url: Column, patterns: list[str]) -> Column:
    """Crawl exclusion: globs match the whole URL, plain patterns match anywhere."""
    wanted = [p.strip() for p in patterns if p and p.strip()]
    if not wanted:
        return F.lit(False)
    plain = [p for p in wanted if not set(p) & set("*?[]")]
    globs = [glob_to_regex(p) for p in wanted if set(p) & set("*?[]")]
    tests = [url.contains(p) for p in plain]
    if globs:
        tests.append(url.rlike("|".join(globs)))
    return any_of(tests)


def glob_to_regex(pattern: str) -> str:
    """Shell glob as an anchored Java pattern; every other character is quoted."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", r"\^")) + "]")
            i = close
        else:
            out.append("\\" + c if not c.isalnum() and ord(c) < 128 else c)
        i += 1
    return r"(?s:\A" + "".join(out) + r"\z)"


# -- links -----------------------------------------------------------------------------------
def _fold_dots(segments: Column) -> Column:
    """Resolve ``.`` and ``..`` in a list of path segments."""
    return F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )


def _resolve_path(full: Column) -> Column:
    """Remove dot segments from an absolute path; most paths have none and pass through."""
    folded = F.array_join(_fold_dots(F.split(F.substr(full, F.lit(2)), "/")), "/")
    slash = F.when(full.rlike(r"/\.\.?$") & (folded != ""), "/").otherwise("")
    return F.when(full.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), folded, slash)).otherwise(full)


def resolve(base: Column, ref: Column) -> Column:
    """Reference resolution against the page URL. Site-absolute links without dots take a short way."""

    def full(s: Column) -> Column:
        base, ref = s["base"], s["ref"]
        root = F.concat(scheme(base), F.lit("://"), netloc(base))
        tail = F.concat(
            F.regexp_extract(raw_path(ref), r";[^/]*$", 0),
            F.when(query(ref) != "", F.concat(F.lit("?"), query(ref))).otherwise(""),
            F.when(fragment(ref) != "", F.concat(F.lit("#"), fragment(ref))).otherwise(""),
        )
        at = path(ref)
        folder = F.regexp_replace(path(base), r"[^/]*$", "")
        merged = F.regexp_replace(
            F.concat(F.when(folder == "", "/").otherwise(folder), at), r"(?<=/)/+(?=[^/])", ""
        )
        own_query = F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise("")
        return (
            F.when((scheme(ref) != "") & (scheme(ref) != scheme(base)), ref)
            .when(netloc(ref) != "", F.concat(scheme(base), F.lit("://"), netloc(ref), at, tail))
            .when(at.startswith("/"), F.concat(root, _resolve_path(at), tail))
            .when((at == "") & ref.startswith("?"), F.concat(root, path(base), tail))
            .when(at == "", F.concat(root, raw_path(base), own_query, tail))
            .otherwise(F.concat(root, _resolve_path(merged), tail))
        )

    def quick(s: Column) -> Column:
        root = F.regexp_extract(s["base"], r"^[a-z][a-z0-9+.\-]*://[^/?#]+", 0)
        plain = s["ref"].rlike(r"(?s)^/(?!/)(?:(?!/\.)[^?#])*(?:\?[^#]+)?(?:#.+)?$")
        return F.when(plain & (root != ""), F.concat(root, s["ref"])).otherwise(full(s))

    return let(F.struct(base.alias("base"), ref.alias("ref")), quick)


def link_matches(html: Column) -> Column:
    """Raw link texts of a page in attribute-class order, then position; repeats are kept."""
    quoted = r"""=["']([^"']+)["']"""
    found = F.concat(
        F.regexp_extract_all(html, F.lit("(?i)href" + quoted), 1),
        F.regexp_extract_all(html, F.lit("(?i)data-href" + quoted), 1),
        F.regexp_extract_all(html, F.lit("(?i)data-url" + quoted), 1),
        F.regexp_extract_all(
            html, F.lit(r"""(?i)(?:window\.location|location\.href)\s*=\s*["']([^"']+)["']"""), 1
        ),
    )
    return F.filter(found, lambda l: ~l.startswith("#") & ~l.startswith("javascript:"))
