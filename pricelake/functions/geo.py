"""Geography Column expressions over fixed rule tables (10 countries, so literals, not joins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelake.functions import rules, urls
from pricelake.functions.expr import let


def by_country(country: Column, test) -> Column:
    """``test(code)`` chosen by the row's country; false for an unknown country."""
    codes = list(rules.COUNTRY_TLDS)
    chain = F.when(country == codes[0], test(codes[0]))
    for code in codes[1:]:
        chain = chain.when(country == code, test(code))
    return F.coalesce(chain, F.lit(False))


def country_code(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.COUNTRY_ALIASES.items() for x in pair])
    return F.try_element_at(table, F.upper(name))


def city_is_known(country: Column, city: Column) -> Column:
    return by_country(country, lambda code: F.upper(city).isin(rules.COUNTRY_CITIES[code]))


def is_country_host(url: Column, country: Column, mode: str = "label") -> Column:
    """Country top-level domain, known shop, or a country word in the host.

    ``mode='label'`` wants the word as a whole host label (parts split at dots and hyphens);
    ``mode='compat'`` accepts it anywhere, so that ``co`` matches every ``.com``.
    """

    def test(where: Column, code: str) -> Column:
        words = rules.COUNTRY_HOST_WORDS[code]
        if mode == "compat":
            named = "|".join(_quoted(words))
        else:
            named = r"(?:^|[.\-])(?:" + "|".join(_quoted(w for w in words if "." not in w)) + r")(?:$|[.\-:])"
        suffix = "(?:" + "|".join(_quoted(rules.COUNTRY_TLDS[code])) + ")$"
        shops = "^(?:" + "|".join(_quoted(rules.COUNTRY_SHOPS[code])) + ")$"
        return where.rlike(f"{suffix}|{shops}|{named}")

    return let(F.lower(urls.netloc(url)), lambda where: by_country(country, lambda code: test(where, code)))


def _quoted(words) -> list[str]:
    return [w.replace(".", r"\.") for w in words]


def has_country_path(url: Column, country: Column, city: Column | None = None) -> Column:
    """A country or city mark in the path or in the query string."""

    def test(rest: Column) -> Column:
        found = by_country(country, lambda code: rest.rlike("|".join(rules.COUNTRY_PATH_WORDS[code])))
        if city is None:
            return found
        low = F.lower(city)
        marks = [F.concat(F.lit(head), low, F.lit(tail)) for head, tail in (("/", "/"), ("city=", ""), ("location=", ""))]
        in_city = reduce(lambda a, b: a | b, [F.contains(rest, m) for m in marks])
        return found | F.coalesce((low != "") & in_city, F.lit(False))

    # a blank between path and query keeps a mark from spanning both
    return let(F.lower(F.concat(urls.path(url), F.lit(" "), urls.query(url))), test)


def is_foreign(url: Column) -> Column:
    return F.lower(url).rlike("(?:" + "|".join(_quoted(rules.FOREIGN_TLDS)) + ")(?:/|$)")


def is_home_url(url: Column) -> Column:
    """Uruguay test used by page typing."""

    def test(s: Column) -> Column:
        return s["where"].rlike("(?:" + "|".join(_quoted(rules.HOME_TLDS)) + ")$|uruguay") | s["rest"].rlike(
            "uruguay|/uy/|montevideo"
        )

    parts = lambda low: F.struct(
        urls.netloc(low).alias("where"), F.concat(urls.path(low), F.lit("?"), urls.query(low)).alias("rest")
    )
    return let(let(F.lower(url), parts), test)


def location_signal(url: Column, title: Column, snippet: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (url, title, snippet)]
    return F.when(F.lower(F.concat_ws(" ", *parts)).rlike("|".join(rules.LOCATION_WORDS)), 1.0).otherwise(0.0)
